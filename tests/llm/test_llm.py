import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.llm import components, cosine_join, leaks, overlap, packing, sentences

IDENTITY = "identity struct<document_cluster_id:string,counterfactual_pair_id:string,generative_family_key:string>"
SIGS = "sample_id string, role string, source_id string, perceptual_hash string, table_sha256 string, structure_sha256 string, registered_at timestamp_ntz"
AT = datetime(2026, 1, 1)


# Problem 3


def unit(rng, terms):
    w = {t: rng.random() + 0.01 for t in terms}
    n = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / n for t, x in w.items()}


@pytest.mark.parametrize("threshold", [0.3, 0.7, 1.0])
def test_cosine_join(spark, threshold):
    rng = random.Random(4)
    side = lambda n: [unit(rng, {min(int(rng.expovariate(0.3)), 15) for _ in range(rng.randrange(1, 9))}) for _ in range(n)]
    left, right = side(60), side(40)
    right[0] = left[0]
    frame = lambda s: spark.createDataFrame([(i, t, w) for i, v in enumerate(s) for t, w in v.items()], "id int, term int, weight double")
    want = {(i, j): d for i, x in enumerate(left) for j, y in enumerate(right) if (d := sum(w * y.get(t, 0) for t, w in x.items())) >= threshold - 1e-9}
    got = {(r.left_id, r.right_id): r.cosine for r in cosine_join.cosine_join(frame(left), frame(right), threshold).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert cosine_join.cosine_join(frame([]), frame(right), threshold).count() == 0


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(8)
    near = lambda h: h ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5)))
    hashes = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(150):
        h = near(rng.choice(hashes)) & ((1 << 64) - 1)
        rows.append((f"s{i:03d}", rng.choice(["train", "TRAIN ", "dev", "hold-out", "Validation", "other", None]), "src", rng.choice([f"{h:016x}", f"0x{h:016X}", None, "0" * 16, "n/a"]), rng.choice([f"{rng.randrange(60):x}", f"sha256:{rng.randrange(60):064x}", None, "0"]), rng.choice(["ab", "AB ", "cd", None]), AT))
    rows += rows[:5] + [("s000", "train", "src", "1", "ff", "ab", datetime(2025, 1, 1)), (None, "train", "s", "1", "1", "ab", AT)]
    def number(v):
        v = (v or "").strip().lower().removeprefix("sha256:").removeprefix("0x")
        try:
            return int(v, 16) or None
        except ValueError:
            return None
    roles = {"train": "t", "TRAIN ": "t", "dev": "o", "hold-out": "o", "Validation": "o"}
    last = {r[0]: r for r in rows[:150]}
    want = set()
    for a in last.values():
        for b in last.values():
            if roles.get(a[1]) == "t" and roles.get(b[1]) == "o":
                ta, tb, ha, hb, sa, sb = number(a[4]), number(b[4]), number(a[3]), number(b[3]), number(a[5]), number(b[5])
                if ta is not None and ta == tb:
                    want.add((a[0], b[0], "exact"))
                elif sa is not None and sa == sb and ha is not None and hb is not None and (ha ^ hb).bit_count() <= 3:
                    want.add((a[0], b[0], "near"))
    got = [(r.train_sample, r.other_sample, r.overlap_kind) for r in overlap.overlaps(spark.createDataFrame(rows, SIGS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for *_, k in want} == {"exact", "near"}
    assert overlap.overlaps(spark.createDataFrame([], SIGS)).count() == 0


def test_lists_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Files as small as these, Spark would broadcast whatever they are exploded to."""
    plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    plans, cut = [], cosine_join.cut
    monkeypatch.setattr(cosine_join, "cut", lambda df: (plans.append(plan(df)), cut(df))[1])
    rows = [(f"s{i}", ("train", "dev")[i % 2], "src", f"{1000 + i // 4:x}", f"{100 + i // 3:x}", "ab", AT) for i in range(40)]
    spark.createDataFrame(rows, SIGS).write.parquet(str(tmp_path / "sigs"))
    sigs = spark.read.parquet(str(tmp_path / "sigs"))
    plans += [plan(overlap.overlaps(sigs)), plan(overlap.overlap_counts(sigs))]
    assert len(plans) >= 6 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


# Problem 4


def records(spark, rows):
    return spark.createDataFrame([(s, AT, k) for s, k in rows], f"sample_id string, revised_at timestamp_ntz, {IDENTITY}")


def test_components_against_union_find(spark):
    rng = random.Random(6)
    key = lambda p, n: rng.choice([f"{p}{rng.randrange(1, n)}", f" {p.upper()}{rng.randrange(1, n)}\t", None, "", "N/A", f"{p}none", f"{p}000", "unknown"])
    rows = [(f"s{i:03d}", (key("document-", 40), key("pair-", 40), key("", 40))) for i in range(120)]
    parent = {s: s for s, _ in rows}
    find = lambda s: s if parent[s] == s else find(parent[s])
    first = {}
    for s, ks in rows:
        for f, k in enumerate(ks):
            k = (k or "").strip().lower()
            bare = k.removeprefix("document-").removeprefix("pair-")
            if bare in ("", "n/a", "none", "unknown") or not bare.strip("0"):
                continue
            a, b = find(first.setdefault((f, k), s)), find(s)
            parent[max(a, b)] = min(a, b)
    want = {(find(s), s) for s, _ in rows if find(s) != s}
    got = {(r.root, r.sample) for r in components.components(components.key_links(records(spark, rows + rows[:4]))).collect() if r.root != r.sample}
    assert got == want and len(want) > 20


def test_long_chain_and_hot_key(spark):
    chain = [(f"s{i:04d}", (f"d{i // 2}", f"p{(i + 1) // 2}", None)) for i in range(300)]
    hot = [(f"h{i:04d}", ("same", None, None)) for i in range(300)]
    got = components.components(components.key_links(records(spark, chain + hot))).groupBy("root").count().collect()
    assert {(r.root, r["count"]) for r in got} == {("s0000", 300), ("h0000", 300)}


def test_subset_sums():
    rng = random.Random(9)
    for _ in range(60):
        sizes = {s: rng.randrange(1, 4) for s in rng.sample(range(1, 30), rng.randrange(1, 5))}
        want = rng.randrange(0, 60)
        sums = {0}
        for s, n in sizes.items():
            sums = {t + s * k for t in sums for k in range(n + 1)}
        got = components.subset_sum(sizes, want)
        assert all(0 <= n <= sizes[s] for s, n in got.items())
        assert abs(sum(s * n for s, n in got.items()) - want) == min(abs(t - want) for t in sums)
    assert components.subset_sum({}, 5) == {}


def test_roles(spark, monkeypatch):
    rows = [(f"s{i:03d}", (f"d{i // 7}" if i < 70 else None, None, None)) for i in range(200)]
    df = records(spark, rows)
    groups = components.components(components.key_links(df))
    targets = spark.createDataFrame([("train", 0.7), ("development", 0.2), ("holdout", 0.1)], "role string, share double")
    got = components.assign_roles(df.select(F.col("sample_id").alias("sample")), groups, targets)
    assert {r.role: r["count"] for r in got.groupBy("role").count().collect()} == {"train": 140, "development": 40, "holdout": 20}
    assert got.groupBy("group_first").agg(F.countDistinct("role").alias("n")).where("n > 1").count() == 0
    none = components.assign_roles(df.select(F.col("sample_id").alias("sample")), groups, targets.limit(0))
    assert none.count() == 200 and none.where("role is not null").count() == 0
    empty = components.components(components.key_links(df.limit(0)))
    assert components.assign_roles(df.limit(0).select(F.col("sample_id").alias("sample")), empty, targets).count() == 0


def test_choice_beyond_millions():
    """Totals far beyond any bitset of earlier bounds, met exactly, by the share of each size or by all groups."""
    sizes = {1: 3_000_000, 2: 500_000, 7: 90_000, 1000: 700, 2_000_000: 1, 12_345: 3}
    total = sum(s * n for s, n in sizes.items())
    shares = {"train": 0.8, "development": 0.1, "holdout": 0.1}
    got = components.choose_sizes(sizes, shares)
    sums = {r: sum(s * n for s, n in p.items()) for r, p in got.items()}
    assert all(sum(got[r].get(s, 0) for r in got) == n for s, n in sizes.items())
    assert sums["development"] == round(total * 0.1) and sums["holdout"] == round(total * 0.1)
    odd = {s: 1 for s in range(1001, 5000, 2)} | {2000: 40}  # few of each: the whole bitset of six million is needed
    want = round(sum(s * n for s, n in odd.items()) * 0.13)
    assert sum(s * n for s, n in components.subset_sum(odd, want).items()) == want


def test_shares_of_groups_of_even_size():
    got = components.choose_sizes({4: 10, 6: 5}, {"a": 0.5, "b": 0.25, "c": 0.25})
    assert sorted(sum(s * n for s, n in p.items()) for p in got.values()) in ([16, 18, 36], [16, 20, 34], [18, 18, 34])


def test_patterns_use_up_all_items():
    rng = random.Random(10)
    for _ in range(40):
        capacity = rng.choice([10, 30, 100])
        counts = {x: rng.randrange(1, 50) for x in rng.sample(range(1, capacity + 1), rng.randrange(1, 10))}
        made = packing.patterns(counts, capacity)
        used = Counter()
        for held, times in made:
            assert 0 < sum(held) <= capacity and times > 0
            for x in held:
                used[x] += times
        assert used == Counter(counts)


def test_exact_complements():
    # 7 + 2 + 1, 6 + 4, 5 + 5: all containers can be full, and are.
    counts = {7: 5, 2: 5, 1: 5, 6: 9, 4: 9, 5: 8}
    made = packing.patterns(counts, 10)
    assert sum(n for _, n in made) == sum(x * n for x, n in counts.items()) // 10
    sums = packing.Sums(Counter({5: 1, 3: 2}), 12)
    assert sums.exact(10) is None and sums.exact(6) == (3, 3) and sums.exact(11) == (5, 3, 3) and sums.exact(5) == (5,)


def test_packing(spark):
    rng = random.Random(11)
    rows = [(i, i, rng.choice([0, 1, 3, 7, 20, 20, 50, 64, 65, 300, 1000])) for i in range(400)] + [(None, 5, 9)]
    lengths = spark.createDataFrame(rows + rows[:20], "doc_id bigint, text_hash bigint, n_tokens bigint")
    caps = spark.createDataFrame([("small", 64), ("large", 300), ("none", None), ("bad", 0)], "container_kind string, capacity_tokens int")
    got = packing.pack(lengths, caps)
    assert {r[0] for r in got.select("container_kind").distinct().collect()} == {"small", "large"}
    for kind, cap in (("small", 64), ("large", 300)):
        part = got.where(F.col("container_kind") == kind)
        docs = {(r.doc_id, r.text_hash): r for r in part.groupBy("doc_id", "text_hash").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()}
        assert {k: v.n for k, v in docs.items()} == {(d, h): n for d, h, n in rows}
        assert all(docs[d, h].k == max(1, -(-n // cap)) for d, h, n in rows)
        held = {}
        for r in part.where("container_id is not null").collect():
            held.setdefault(r.container_id, []).append((r.token_offset, r.n_tokens, r.position))
        for places in held.values():
            at = 0
            for i, (offset, n, position) in enumerate(sorted(places)):
                assert (offset, position) == (at, i)
                at += n
            assert at <= cap
        assert part.where("n_tokens = 0 and container_id is not null").count() == 0
        # No more containers than first-fit decreasing needs.
        free: list[int] = []
        for n in sorted((min(cap, n - k * cap) for _, _, n in rows for k in range(-(-n // cap))), reverse=True):
            i = next((i for i, f in enumerate(free) if f >= n), None)
            free.append(cap - n) if i is None else free.__setitem__(i, free[i] - n)
        assert len(held) <= len(free)
    assert packing.pack(lengths, caps.limit(0)).count() == 0 and packing.pack(lengths.limit(0), caps).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "a b <|endoftext|>", 7), (2, None, 7), (3, "", 7), (4, "语" * 2000, 7), (1, "a b <|endoftext|>", 7)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in packing.token_lengths(docs).collect()}
    assert got[2] == got[3] == 0 and got[1] > 3 and got[4] > 0 and packing.token_lengths(docs).count() == 4
    text = "word " * 200_000
    assert abs(packing.count_tokens(text) - 200_000) < 10


def test_long_texts_count_as_whole(monkeypatch):
    """Cut between the tokenizer's own pieces, a text has the tokens of the whole, with white space anywhere, everywhere or nowhere."""
    rng = random.Random(4)
    marks = ["a", "Be", " ", "  ", "\n", "\t ", "\x1f", "\u3000", "é", "語", "12", "!?", "'s", "...", "\u0301"]
    texts = ["".join(rng.choice(marks) for _ in range(400)) for _ in range(60)] + ["x" * 300, " " * 300 + "a", "語" * 300, "a" + " " * 300]
    whole = [packing.count_tokens(t) for t in texts]
    for size in (1, 7, 50):
        monkeypatch.setattr(packing, "SEGMENT", size)
        assert [packing.count_tokens(t) for t in texts] == whole
    monkeypatch.undo()
    assert packing.count_tokens("a" + " " * 3_000_000 + "b") > 1


# Problem 7

ITEM = "Which of the 49 headers does Zorthaxdre share with Pélsarnrud if a blurred stub is read after Ekkowextov?"
ZH = "在齐扎涅弗与涅黎齐之间画出3条线使托涅扎杰能够读出左边距而不依赖沙弗齐戈规则"


def test_guises():
    grams = leaks.Grams([(1, ITEM, "en"), (2, ZH, "zh"), (3, "too short to leak", "en")])
    words = ITEM.rstrip("?").split()
    found = lambda t: set(grams.scan(t))
    cut = " ".join(words[3:15])
    assert found(cut) == {1} and found(" ".join(words[3:14])) == set() and found(ITEM) == {1}
    for guise in (cut.upper(), cut.replace("é", "e\u0301"), cut.replace(" ", " \n "), cut.replace("share", "<b>sh</b>are"), cut.replace(" share", "<td>share</td>"), cut.replace("headers", "head\u200bers\u00ad"), cut.replace("headers", "head-\n  ers"), cut.replace(" ", "-"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in cut), cut.replace(" ", "&nbsp;"), f"x {cut} y", cut.replace("headers does", "headers-\ndoes")):
        assert found(guise) == {1}, guise
    assert found(" ".join(words[3:9] + ["extra"] + words[9:16])) == set()
    assert found(ZH[2:26]) == {2} and found(ZH[2:25]) == set() and found("\n".join(ZH)) == {2}
    assert found("too short to leak " * 9) == set() and found("") == set()


def test_leaks_against_plain_scan(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30)), "en", "s") for i in range(20)]
    docs = []
    for i in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            it = rng.choice(items)[1].split()
            a, n = rng.randrange(18), rng.randrange(8, 16)
            body[rng.randrange(len(body) + 1) : 0] = it[a : a + n]
        docs.append((i, " ".join(body), "x"))
    docs += [(900, None, "x"), (901, "", "x"), docs[0]]
    grams = {(i, " ".join(t.split()[k : k + 12])) for i, t, *_ in items for k in range(19)}
    want = {(d, i) for d, t, _ in docs if t for k in range(len(t.split()) - 11) for i, g in grams if g == " ".join(t.split()[k : k + 12])}
    D = spark.createDataFrame(docs, "doc_id bigint, text string, TEXT string")
    I = spark.createDataFrame(items + items[:2], "item_id bigint, text string, lang string, suite string")
    for batch in (4_000_000, 500):  # the second needs many broadcasts
        monkeypatch.setattr(leaks, "BATCH_CHARS", batch)
        got = leaks.find_leaks(D, I)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert leaks.find_leaks(D, I.limit(0)).count() == 0 and leaks.find_leaks(D.limit(0), I).count() == 0


def test_decontamination(spark):
    docs = spark.createDataFrame([(1, f"Before. <b>{ITEM.upper()}</b> After."), (2, "clean"), (3, None), (4, f"一。{ZH}。二")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM, "en"), (2, ZH, "zh")], "item_id bigint, text string, lang string")
    got = {r.doc_id: r for r in leaks.decontaminate(docs, items).collect()}
    assert got[1].text == "Before. <b>?</b> After." and got[2].text == "clean" and got[3].text is None and got[4].text == "一。。二"
    assert got[1].removed_chars > 50 and got[2].removed_chars == 0
    assert leaks.find_leaks(spark.createDataFrame([(d, r.text) for d, r in got.items()], "doc_id bigint, text string"), items).count() == 0
    assert {r.doc_id for r in leaks.decontaminate(docs, items, "documents").collect()} == {2, 3}


def test_decontamination_of_guises(spark, monkeypatch):
    broken = ITEM.replace("headers does", "well known headers does")
    split = broken.replace("well known", "well-\nknown")
    texts = {1: f"Before. {split} After.", 2: f"A &amp; B &lt; C &#38; D. {ITEM} After.", 3: f"Q&ampA. {ITEM.replace(' ', '&nbsp;')} After.", 4: f"{ITEM[:40]}{ITEM}{ITEM[40:]}", 5: f"{ITEM[:40]}{broken}{ITEM[40:]}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM, "en"), (2, broken, "en")], "item_id bigint, text string, lang string")
    for batch in (4_000_000, 60):
        monkeypatch.setattr(leaks, "BATCH_CHARS", batch)
        got = leaks.decontaminate(docs, items).localCheckpoint()
        assert leaks.find_leaks(got, items).count() == 0
        left = {r.doc_id: r for r in got.collect()}
        assert left[1].text == "Before. ? After." and left[2].text == "A &amp; B &lt; C &#38; D. ? After." and left[3].text == "Q&ampA. ? After."
        assert all(r.removed_chars == len(texts[d]) - len(r.text) for d, r in left.items())


def test_long_markup_and_mixed_hyphens():
    item = ITEM.replace("headers does", "well known headers does")
    grams = leaks.Grams([(1, item, "en")])
    words = item.rstrip("?").split()
    cut = " ".join(words[3:15])
    long = f'<a href="{"x y " * 200}">'
    guises = [cut.replace("headers", f"{long}headers</a>"), cut.replace("headers", "head<!-- not\nthis > -->ers") + " <!-- open", cut.replace("well known headers", "well-\nknown head-\ners"), cut.replace("well known headers", "well-\nknown he-\na-\nders")]
    guises += [f"<!-- {cut} -->", f"a <b {'c ' * 100} {cut} {'c ' * 100}> d"]
    for guise in guises:
        assert set(grams.scan(guise)) == {1}, guise
        left, gone = leaks.without_leaks(f"Before. {guise} After.", grams)
        assert gone and not grams.scan(left) and left.startswith("Before. ") and left.endswith(" After.")
    assert not grams.scan(cut.replace("well known", "we-\nll known").replace("headers", "heads-\nx"))
    assert not grams.scan("<a " * 20_000 + "<!-- " * 20_000) and not grams.scan("well-\nknown-\n" * 2_000)


def test_hyphens_of_items_are_read_both_ways():
    words = "the well known head rows of a wide table stand above all other rows here".split()
    plain = " ".join(words)
    closed = plain.replace("well known", "wellknown")
    grams = leaks.Grams([(1, plain.replace("well known", "well-\nknown"), "en"), (2, plain.replace("well known", "well-\nknown").replace("table", "ta-\nble"), "en")])
    assert set(grams.scan(plain)) == {1, 2} and set(grams.scan(closed)) == {1, 2}
    assert set(grams.scan(plain.replace("table", "ta ble"))) == {2}
    assert set(leaks.Grams([(1, plain, "en")]).scan(plain.replace("table", "ta ble"))) == set()


def test_equal_hashes_find_nothing(monkeypatch):
    monkeypatch.setattr(leaks, "_hash", lambda text: len(text) % 3)
    grams = leaks.Grams([(1, ITEM, "en"), (2, ZH, "zh")])
    assert set(grams.scan("before " + ITEM + " after")) == {1} and set(grams.scan(ZH)) == {2}
    assert not grams.scan("word " * 40) and not grams.scan("語" * 40)


def test_mixed_hyphens_against_all_readings():
    rng = random.Random(17)
    vocab = ["a", "b", "ab", "ba", "aa", "c"]
    for _ in range(60):
        grams = leaks.Grams([(i, " ".join(rng.choice(vocab) for _ in range(16)), "en") for i in range(3)])
        by_words = {}
        for item, held in zip(grams.items, grams.sequences):
            for k in range(len(held) - 11):
                by_words.setdefault(" ".join(held[k : k + 12]), set()).add(item)
        body = rng.choice(sorted(by_words))
        text = "".join(c if c != " " else rng.choice([" ", " ", "-\n"]) for c in f"c {body} a")
        text = "".join(c + ("-\n" if c.isalpha() and n.isalpha() and rng.random() < 0.5 else "") for c, n in zip(text, text[1:] + " "))
        parts = text.split("-\n")
        want = set()
        for bits in range(1 << (len(parts) - 1)) if len(parts) < 13 else ():
            read = parts[0] + "".join((" " if bits >> k & 1 else "") + p for k, p in enumerate(parts[1:]))
            w = read.split()
            want |= {i for k in range(len(w) - 11) for i in by_words.get(" ".join(w[k : k + 12]), ())}
        if len(parts) < 13:
            assert set(grams.scan(text)) == want


def test_maps_agree_with_variants():
    rng = random.Random(15)
    parts = ["é", "e\u0301", "<b>", "</td>", "<x y", "<!--", "-->", f"<i {'z' * 300}>", "\ue000", "&#xe000;", "&amp;", "&nbsp", "&#60;", "&copy;x", "&notit;", "-\n", "\u00ad \n ", "ﬁ", "Ⅷ", "ß", "İ", "각", "한", "a", "9", "_", " ", "\u0327\u0301", "齐", "ΐ", "ｶﾞ"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(15))
        mapped = leaks._map_variants(t)
        assert [m[0] for m in mapped] == leaks.variants(t)
        assert all(len(f) == len(a) == len(b) and all(0 <= i < j <= len(t) for i, j in zip(a, b)) for f, a, b in mapped)


# Problem 8

SENTENCES = [
    ["Dr. Murnista and Prof. Sarnulm compared it on p. 36.", "He left."],
    ["It begins at 3.60 and ends in the U.S. edition of v2.1.", "see table.6.csv, e.g. for more."],
    ['She wrote "Keep it. Do not merge it." beside the mark.', "Why?", "What, this too?!"],
    ["‘Stop!’ Thaxtov called, but it went on.", "It ends (see Tab. 18. It is split there) at 96.25%."],
    ["The stub loses the slots ... and then stops.", "Nobody knows…", "Then it ends."],
    ["The rule.", "approx. 54 tokens belong here.", "cell_id 3 stays.", "J. K. Lund keeps plan B.", "The end."],
    ["Hr. Dr. Veknyx zeigt z. B. auf S. 21 ca. 3 Felder usw.", "Am 11. Okt. prüfte Fr. Ulm die „Zahl. Und mehr.“ neben dem Rand."],
    ["Доля выросла с 80,35 до 36,3 проц. за год.", "И. К. Рудвекс видел т. е. 69,41 мм.", "Сюда входят места и т. д.", "«Это?» — спросил он."],
    ["La fig. 62 montre, p. ex. à 34,7 mm.", "Quoi, une colonne aussi ?!", "On a noté « Ne rien couper. Tout garder. » près de là."],
    ["¿Por qué?", "¡El registro cubre!", "El Sr. Pelmurn y la Dra. Vekista vieron la pág. 52."],
    ["यह क्या है?", "डॉ. ज़ुलाम ने 56.08 मिमी पर देखा।", "“यह क्या है? इसे मत जोड़ो।” उसने कहा।"],
    ["راجع د. ثاكسم الإطار عند 40.89 ملم.", "قال: «ما هذا؟ لا تدمج.» ثم مضى."],
    ["ทำไมคอลัมน์จึงทำซ้ำ", "หน้าที่เอียงลบ 71 ช่องจาก OCR 2.5 รุ่นใหม่"],
]


@pytest.mark.parametrize("want", SENTENCES)
def test_sentences(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in sentences.split_text(text)] == want


def test_unspaced_and_breaks():
    split = lambda t: [t[a:b] for a, b in sentences.split_text(t)]
    assert split("他问：“这是吗？不要。”然后离开。图例（参见第6节。详细）丢失了！2.5枚？") == ["他问：“这是吗？不要。”然后离开。", "图例（参见第6节。详细）丢失了！", "2.5枚？"]
    assert split("Heading\n\n | a | 1.5 \n \nOne\nsentence here.Next one") == ["Heading", "| a | 1.5", "One\nsentence here.", "Next one"]
    assert split("18. The footer.\n\n3. Next. It ends") == ["18. The footer.", "3. Next.", "It ends"]
    assert split("An open (bracket is no. Matter here.") == ["An open (bracket is no.", "Matter here."]
    assert split(" \n\n \t") == [] and split("") == [] and split("x") == ["x"] and split("...") == ["..."]


def random_text(rng, n):
    parts = [s for group in SENTENCES for s in group] + ["(", ")", "“", "”", '"', "\n\n", "...", "!", "\n", " ", "«", "x" * 40]
    return rng.choice(["", " "]).join(rng.choice(parts) for _ in range(n))


def test_all_text_belongs_to_units():
    rng = random.Random(13)
    for _ in range(200):
        t = random_text(rng, 12)
        at = 0
        for a, b in sentences.split_text(t):
            assert not t[at:a].strip() and t[a:b] == t[a:b].strip() and a < b
            at = b
        assert not t[at:].strip()


def test_chunks_compose(spark, monkeypatch):
    rng = random.Random(14)
    texts = [random_text(rng, n) for n in (5, 40, 90, 200, 200)]
    for t in texts:
        for size in (97, 400):
            state, ends = 0, []
            for k in range(0, len(t), size):
                ends += sentences.part_boundaries(sentences.View(t), state, k, k + size)[0]
                state = sentences.chunk_function(t, k, k + size)[state]
            assert sentences.units(t, ends) == sentences.split_text(t)
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, None), (8, ""), (9, "  "), (1, texts[1]), (1, "another"), (None, texts[4])]
    want = {(i, a, b) for i, t in docs if t for a, b in sentences.split_text(t)}
    monkeypatch.setattr(sentences, "CHUNK", 500)
    got = [(r.doc_id, r.start_char, r.end_char) for r in sentences.sentence_units(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_far_closers_and_deep_nesting(spark, monkeypatch):
    far = "He said: “" + "It stays. " * 400 + "It ends.” Then he left."
    blank = "One “two. " + "It stays. " * 400 + "\n \nIt ends.” Then he left."
    deep = "It (see (a (b. C) d. E) f. G) ends. Next (one [two “three. Four” five. Six] seven. Eight) nine."
    assert [far[a:b] for a, b in sentences.split_text(far)] == [far[:-14], "Then he left."]
    assert len(sentences.split_text(blank)) == 403
    assert [deep[a:b] for a, b in sentences.split_text(deep)] == ["It (see (a (b. C) d. E) f. G) ends.", "Next (one [two “three. Four” five. Six] seven. Eight) nine."]
    loose = "The ‘open mark. " + "We don’t know. " * 400
    assert len(sentences.split_text(loose)) == 401
    rng = random.Random(16)
    for _ in range(200):
        t = random_text(rng, 15)
        found, beyond = sentences.part_boundaries(sentences.View(t), 0, 0, len(t))
        if not beyond:
            assert sentences.nested_boundaries(t) == found
    texts = [far * 3, far.replace("” Then", " Then") * 3, "x. " * 2000 + deep * 40, deep + "y. " * 3000, blank * 4]
    want = {(i, a, b) for i, t in enumerate(texts) for a, b in sentences.split_text(t)}
    monkeypatch.setattr(sentences, "CHUNK", 500)
    got = [(r.doc_id, r.start_char, r.end_char) for r in sentences.sentence_units(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_windows_lose_nothing(spark, monkeypatch):
    """What lies beyond a chunk's surroundings is told from the whole text: long gaps, words, numbers and runs of marks at chunk edges."""
    rng = random.Random(18)
    odd = [" " * 30, "a.b." * 12, "9" * 30, "." * 25, "x" * 30 + ".", "\n" + " " * 20 + "\n", "z." + " " * 20 + "B.", "12." + " " * 25 + "Mai", "ไทย" + " " * 20 + "ไทย", "”" + " " * 30, "Dr." + "\n" * 25, "१" * 20 + "."]
    texts = ["".join(rng.choice([random_text(rng, 2), rng.choice(odd)]) for _ in range(n)) for n in (10, 30, 60, 60, 60, 60)]
    monkeypatch.setattr(sentences, "CHUNK", 90)
    monkeypatch.setattr(sentences, "LEFT", 8)
    monkeypatch.setattr(sentences, "RIGHT", 12)
    for t in texts:  # a chunk that is not sure says so
        n = len(sentences.transducer()[2])
        whole = sentences.part_boundaries(sentences.View(t), 0, 0, len(t))[0]
        state = 0
        for k in range(0, len(t), 90):
            f = max(k - 8, 0)
            piece = t[f : k + 102]
            found, beyond = sentences.part_boundaries(sentences.View(piece, f > 0, len(piece) == k + 102 - f), state, k - f, k + 90 - f)
            if beyond:
                break
            assert [f + e for e in found] == sentences.part_boundaries(sentences.View(t), state, k, k + 90)[0]
            state = sentences.chunk_function(t, k, k + 90)[state]
        assert n > 100 and whole
    want = {(i, a, b) for i, t in enumerate(texts) for a, b in sentences.split_text(t)}
    got = [(r.doc_id, r.start_char, r.end_char) for r in sentences.sentence_units(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rules_are_compiled():
    split = lambda t: [t[a:b] for a, b in sentences.split_text(t)]
    assert split("ดร. สมชาย มา พ.ศ. 2568 แล้ว") and "พ.ศ. 2568" in " ".join(split("เริ่มใน พ.ศ. 2568 ที่นี่"))
    assert split("सं. 12 देखें। फिर।") == ["सं. 12 देखें।", "फिर।"]
    assert split("Jan.\n\nb") == ["Jan.", "b"]
    # The trie holds each abbreviation, backwards, with its classes.
    assert sentences._kinds("z.b") == sentences.Kind.INNER and sentences._kinds("b") == sentences.Kind.SECOND and sentences._kinds("zz") == 0
    long = "a.b." * 100_000  # no rule looks back over all of it
    assert len(sentences.split_text(long)) == 1


# Further columns, whatever their names


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "One. Two.", "x", 5, 6, "y")], "doc_id bigint, text string, TEXT string, h bigint, k int, start_char string")
    assert [(r.start_char, r.end_char) for r in sentences.sentence_units(docs).orderBy("start_char").collect()] == [(0, 4), (5, 9)]
    assert packing.token_lengths(docs.withColumn("text_hash", F.lit(0))).first().n_tokens > 0
    sigs = spark.createDataFrame([("a", "train", "s", "1", "ff", "ab", AT, "q", 1), ("b", "dev", "s", "1", "ff", "ab", AT, "q", 2)], SIGS + ", ROLE string, bits int")
    assert [(r.train_sample, r.other_sample, r.overlap_kind) for r in overlap.overlaps(sigs).collect()] == [("a", "b", "exact")]
    recs = records(spark, [("a", ("d1", None, None)), ("b", ("D1 ", None, None))]).withColumn("key", F.lit(1)).withColumn("sample", F.lit(2))
    recs = recs.toDF(*recs.columns[:-1], "SAMPLE_ID")
    assert {(r.sample, r.root) for r in components.components(components.key_links(recs)).collect()} == {("a", "a"), ("b", "a")}


def test_hot_classes(spark):
    """Half of all rows in one layout with one hash, far fewer pairs than rows squared elsewhere."""
    rows = [(f"t{i}", "train", "s", "f0f0", f"{i + 1:x}", "aa", AT) for i in range(60)] + [(f"d{i}", "dev", "s", "f0f1", f"{i + 1000:x}", "aa", AT) for i in range(20)]
    got = overlap.overlaps(spark.createDataFrame(rows, SIGS))
    assert got.count() == 60 * 20 and got.select("overlap_kind").distinct().collect()[0][0] == "near"
    assert overlap.near_classes(overlap.signatures(spark.createDataFrame(rows, SIGS))).count() == 1
