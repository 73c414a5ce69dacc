"""Evaluation texts leaking into training text.

The n-grams of the evaluation items - 12 words, or 24 letters and digits for items in
languages without spaces - are broadcast as a hash set, a sorted array of 64-bit hashes, in
batches of bounded size; each document is scanned once per batch. The scan looks up blocks
of half the length, at strides of that length, all blocks of a text at once: a whole
n-gram always covers one such block. A hit is verified by looking up the whole n-grams
around it and comparing their words, so equal hashes of different n-grams find nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import pick
from gridloom.session import cut

WORDS, CHARS = 12, 24
#: Languages whose items are compared by letters and digits.
UNSPACED = ("zh", "ja")
#: Characters of the items of one broadcast. There are about as many n-grams at most, of some 30 bytes each.
BATCH_CHARS = 4_000_000

#: Markup of any length, and tags only if short: what lies between two signs far apart may be text.
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b[^<>]*>")
_COMMENT_OR_TAG = re.compile(rf"<!--.*?-->|{_TAG.pattern}", re.S)
_SHORT_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b[^<>]{0,300}>")
#: As html.unescape finds them.
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_BLOCK_TAGS = frozenset("address article blockquote br caption dd div dl dt h1 h2 h3 h4 h5 h6 hr li ol p pre section table tbody td tfoot th thead tr ul".split())
_BREAK = re.compile(r"[-‐‑­][ \t]*\r?\n\s*")
_DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")
#: Stands for a hyphen at a line break, read as a separator; of private use, so no part of a word.
MARK = "\ue000"
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def fold(text: str) -> str:
    """Without case, accents and other marks, invisible characters and compatibility forms."""
    if text.isascii():
        return text.lower()
    return _DROPPED.sub("", unicodedata.normalize("NFKD", _DROPPED.sub("", unicodedata.normalize("NFKD", text)).casefold()))


def _tag_space(m: re.Match) -> str:
    return " " if m[1] and m[1].lower() in _BLOCK_TAGS else ""


def _markup(text: str) -> Iterator[re.Match]:
    """Comments and tags. None is sought that begins after the last end of a comment, so that open ones cost nothing."""
    last = text.rfind("-->") + 3 if "<!--" in text and "-->" in text else 0
    yield from _COMMENT_OR_TAG.finditer(text, 0, last)
    yield from _TAG.finditer(text, last)


def _readings(text: str) -> list:
    """Ways of finding markup in a text, as functions to its matches, that differ for it; the first leaves out most."""
    if "<" not in text:
        return [lambda t: ()]
    whole, short = ([m.span() for m in f(text)] for f in (_markup, _SHORT_TAG.finditer))
    return [_markup] if whole == short else [_markup, _SHORT_TAG.finditer]


def _sub(text: str, matches: Iterable[re.Match], by) -> str:
    out, last = [], 0
    for m in matches:
        out += [text[last : m.start()], by(m)]
        last = m.end()
    return "".join([*out, text[last:]])


def variants(text: str) -> list[str]:
    """The folded text without markup, hyphens at line breaks closed; if there are any, also with MARK for each. Comments and long tags are also read as text."""
    out = []
    for matches in _readings(text):
        plain = _sub(text, matches(text), _tag_space).replace(MARK, " ")
        if "&" in plain:
            plain = html.unescape(plain).replace(MARK, " ")
        closed = _BREAK.sub("", plain)
        out += [fold(closed)] if closed == plain else [fold(closed), fold(_BREAK.sub(MARK, plain))]
    return out


def words_of(folded: str) -> list[str]:
    return _WORD.findall(folded)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _hashes(texts: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(_hash, texts), dtype=np.uint64)


def _mixed_readings(folded: str) -> Iterator[list[str]]:
    """Runs of WORDS words of a text that touch a MARK, with every mix of closing up and parting at the MARKs in them."""
    at = [m.span() for m in _WORD.finditer(folded)]
    words = [folded[a:b] for a, b in at]
    joins = [not folded[b:c].strip(MARK) for (_, b), (c, _) in zip(at, at[1:])] + [False]
    near = [i for i, j in enumerate(joins) if j]
    for first in sorted({i for j in near for i in range(max(0, j - WORDS), j + 2) if i < len(words)}):
        todo = [(first, [])]
        while todo:
            i, grown = todo.pop()
            if len(grown) == WORDS:
                yield grown
            elif i < len(words):
                word = words[i]
                todo.append((i + 1, [*grown, word]))
                while joins[i]:
                    i += 1
                    word += words[i]
                    todo.append((i + 1, [*grown, word]))


class HashSet:
    """Hashes of texts in a sorted array; each with where it stands, a sequence and a place in it."""

    def __init__(self, hashes: list[np.ndarray], sequence: list[int], place: list[np.ndarray]):
        every = np.concatenate(hashes) if hashes else np.array([], dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        self.sequence = np.repeat(np.array(sequence, dtype=np.int32), [len(h) for h in hashes])[order] if hashes else np.array([], dtype=np.int32)
        self.place = np.concatenate(place)[order].astype(np.int32) if place else np.array([], dtype=np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def holds(self, asked: np.ndarray) -> np.ndarray:
        """Which of the hashes asked are there."""
        at = np.searchsorted(self.hashes, asked)
        at[at == len(self.hashes)] = 0
        return self.hashes[at] == asked if len(self.hashes) else np.zeros(len(asked), dtype=bool)

    def find(self, asked: int) -> Iterator[tuple[int, int]]:
        lo, hi = (np.searchsorted(self.hashes, np.uint64(asked), side=s) for s in ("left", "right"))
        return zip(self.sequence[lo:hi].tolist(), self.place[lo:hi].tolist())


class Grams:
    """The n-grams of a batch of items, and the scan for them.

    ``sequences`` are the items' words, or their letters and digits as one text. An item is
    read with each hyphen at a line break closed and as a separator, in any mix.
    """

    def __init__(self, items: Iterable[tuple[int, str, str]]):
        self.items: list = []
        self.sequences: list = []
        seen: set = set()
        grams: dict[bool, tuple[list, list, list]] = {True: ([], [], []), False: ([], [], [])}
        blocks: dict[bool, list[np.ndarray]] = {True: [], False: []}

        def add(item, held, by_chars: bool) -> None:
            size = CHARS if by_chars else WORDS
            if len(held) < size or (item, by_chars, key := held if by_chars else " ".join(held)) in seen:
                return
            seen.add((item, by_chars, key))
            join = (lambda x: x) if by_chars else " ".join
            n = len(held) - size + 1
            hashes, sequence, place = grams[by_chars]
            hashes.append(_hashes(join(held[i : i + size]) for i in range(n)))
            sequence.append(len(self.sequences))
            place.append(np.arange(n))
            blocks[by_chars].append(_hashes(join(held[i : i + size // 2]) for i in range(len(held) - size // 2 + 1)))
            self.items.append(item)
            self.sequences.append(held)

        for item, text, lang in items:
            by_chars = (lang or "").strip().lower()[:2] in UNSPACED
            for folded in variants(text)[:2]:
                words = words_of(folded)
                add(item, "".join(words) if by_chars else words, by_chars)
                if folded.count(MARK) > 1 and not by_chars:
                    for mixed in _mixed_readings(folded):
                        add(item, mixed, False)
        self.by_words, self.by_chars = HashSet(*grams[False]), HashSet(*grams[True])
        self.word_blocks, self.char_blocks = (HashSet(blocks[k], [0] * len(blocks[k]), [np.zeros(len(h)) for h in blocks[k]]) for k in (False, True))
        self.vocabulary = {w for held in self.sequences if isinstance(held, list) for w in held}
        self.longest = max(map(len, self.vocabulary), default=0)
        self.only_cjk = all(_CJK.search(held[i : i + CHARS // 2]) for held in self.sequences if isinstance(held, str) for i in range(len(held) - CHARS // 2 + 1))

    def _of(self, found: HashSet, gram) -> set:
        """The items that hold the n-gram, words or characters."""
        asked = _hash(gram if isinstance(gram, str) else " ".join(gram))
        return {self.items[k] for k, i in found.find(asked) if self.sequences[k][i : i + len(gram)] == gram}

    def _search(self, held, size: int, blocks: HashSet, grams: HashSet) -> Iterator[tuple[object, int]]:
        """(item, place) of the n-grams of ``held``, words or characters."""
        half, n = size // 2, len(held)
        if n < size or not len(grams):
            return
        join = (lambda x: x) if isinstance(held, str) else " ".join
        at = range(0, n - half + 1, half)
        done = 0
        for b in np.flatnonzero(blocks.holds(_hashes(join(held[i : i + half]) for i in at))).tolist():
            i = at[b]
            for j in range(max(done, i - half), min(i, n - size) + 1):
                for item in self._of(grams, held[j : j + size]):
                    yield item, j
            done = max(done, i + 1)

    def scan(self, text: str) -> dict[object, list[tuple[int, int, int, bool]]]:
        """item -> hits (variant, first, last, by characters), positions of words or of letters and digits."""
        found: dict[object, list] = {}
        for v, folded in enumerate(variants(text)):
            words = words_of(folded)
            for item, j in self._search(words, WORDS, self.word_blocks, self.by_words):
                found.setdefault(item, []).append((v, j, j + WORDS, False))
            if folded.count(MARK) > 1 and len(self.by_words):
                for item, first, last in self._mixed(folded):
                    found.setdefault(item, []).append((v, first, last, False))
            if len(self.by_chars) and (not self.only_cjk or _CJK.search(folded)):
                for item, j in self._search("".join(words), CHARS, self.char_blocks, self.by_chars):
                    found.setdefault(item, []).append((v, j, j + CHARS, True))
        return found

    def _mixed(self, folded: str) -> Iterator[tuple[object, int, int]]:
        """(item, first, last) of n-grams over words of which any may be closed up at a MARK between them; positions of words parted there.

        Readings are followed only by words that items hold, and past half an n-gram only
        if items hold that half. N-grams that touch no MARK are left out.
        """
        at = [m.span() for m in _WORD.finditer(folded)]
        words = [folded[a:b] for a, b in at]
        joins = [not folded[b:c].strip(MARK) for (_, b), (c, _) in zip(at, at[1:])] + [False]

        def follow(i: int, grown: list[str]) -> Iterator[tuple[object, int]]:
            if len(grown) == WORDS // 2 and not self.word_blocks.holds(_hashes([" ".join(grown)]))[0]:
                return
            if len(grown) == WORDS:
                for item in self._of(self.by_words, grown):
                    yield item, i
                return
            word = ""
            while i < len(words) and len(word) + len(words[i]) <= self.longest:
                word += words[i]
                i += 1
                if word in self.vocabulary:
                    yield from follow(i, [*grown, word])
                if not joins[i - 1]:
                    return

        ahead = WORDS  # words from here to the next MARK
        for i in range(len(words) - 1, -1, -1):
            ahead = 0 if joins[i] else ahead + 1
            if ahead < WORDS:
                for item, last in follow(i, []):
                    yield item, i, last


Mapped = tuple[str, list[int], list[int]]


def _replaced(mapped: Mapped, matches: Iterable[re.Match], by) -> Mapped:
    """As ``_sub``, with the places of each character; what replaces a match stands at the whole match."""
    text, starts, ends = mapped
    out, at, to, last = [], [], [], 0
    for m in matches:
        i, j = m.span()
        piece = by(m)
        out += [text[last:i], piece]
        at += starts[last:i] + starts[i : i + 1] * len(piece)
        to += ends[last:i] + ends[j - 1 : j] * len(piece)
        last = j
    return "".join([*out, text[last:]]), at + starts[last:], to + ends[last:]


def _folded(mapped: Mapped) -> Mapped:
    pieces = [fold(c) for c in mapped[0]]
    return "".join(pieces), [i for i, p in zip(mapped[1], pieces) for _ in p], [j for j, p in zip(mapped[2], pieces) for _ in p]


def _map_variants(text: str) -> list[Mapped]:
    """The variants of a text, each with the places in ``text`` where its characters begin and end."""
    out = []
    unmarked = lambda mapped: (mapped[0].replace(MARK, " "), *mapped[1:])
    for matches in _readings(text):
        plain = unmarked(_replaced((text, list(range(len(text))), list(range(1, len(text) + 1))), matches(text), _tag_space))
        plain = unmarked(_replaced(plain, _ENTITY.finditer(plain[0]), lambda m: html.unescape(m[0])))
        closed = _replaced(plain, _BREAK.finditer(plain[0]), lambda m: "")
        out += [_folded(closed)] if closed[0] == plain[0] else [_folded(closed), _folded(_replaced(plain, _BREAK.finditer(plain[0]), lambda m: MARK))]
    return out


def leaked_spans(text: str, grams: Grams) -> list[tuple[int, int]]:
    """Merged spans (start, end) of ``text``, in code points, that hold n-grams of items, in any variant."""
    hits = [h for hs in grams.scan(text).values() for h in hs]
    if not hits:
        return []
    spans = []
    for v, (folded, starts, ends) in enumerate(_map_variants(text)):
        words = [(m.start(), m.end()) for m in _WORD.finditer(folded)]
        chars = [(i, i + 1) for a, b in words for i in range(a, b)]
        for _, a, b, by_chars in (h for h in hits if h[0] == v):
            units = chars if by_chars else words
            spans.append((starts[units[a][0]], ends[units[b - 1][1] - 1]))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def without_leaks(text: str, grams: Grams) -> tuple[str, int]:
    """The text without leaked spans, and how many characters went. What a cut joins is scanned again."""
    whole = len(text)
    while spans := leaked_spans(text, grams):
        kept, last = [], 0
        for a, b in spans:
            kept.append(text[last:a])
            last = b
        text = "".join(kept) + text[last:]
    return text, whole - len(text)


def _batches(items: DataFrame) -> Iterator[Grams]:
    """The items' n-grams in batches of about BATCH_CHARS characters: what is broadcast doesn't grow with the items."""
    usable = pick(items, "item_id", "text", "lang").where("text is not null").distinct()
    total = usable.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-total // BATCH_CHARS)
    for b in range(n):
        part = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Grams([(r.item_id, r.text, r.lang) for r in part.collect()])


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents holding an n-gram of an item, each pair once.

    Null and empty texts hold nothing; items shorter than an n-gram never leak. Case,
    accents, punctuation, white space, markup tags and comments, invisible characters,
    compatibility forms and hyphens at line breaks make no difference. Repeated documents count once.
    """
    spark = documents.sparkSession
    docs = pick(documents, "doc_id", "text").where("text is not null")
    items = pick(items, "item_id", "text", "lang")
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType)])
    out = spark.createDataFrame([], schema)
    for grams in _batches(items):
        shared = spark.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1)):
                    hits = grams.scan(text.as_py())
                    at += [i] * len(hits)
                    found += hits
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out.distinct()


def decontaminate(documents: DataFrame, items: DataFrame, mode: str = "spans") -> DataFrame:
    """``documents`` without what leaked: whole documents (``documents``) or the leaked spans (``spans``).

    Spans are cut from the text as it was found, from the first to the last character of
    the n-grams, until what is left holds none; ``removed_chars`` says how much went. Other
    columns stay as they are.
    """
    if mode == "documents":
        return documents.join(find_leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
    if mode != "spans":
        raise ValueError("mode is 'spans' or 'documents'")
    out = documents.withColumn("removed_chars", F.lit(0))
    while True:
        batches = 0
        before = out
        for grams in _batches(items):
            batches += 1
            shared = documents.sparkSession.sparkContext.broadcast(grams)

            @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
            def clean(texts, shared=shared):
                import pandas as pd

                return pd.DataFrame([without_leaks(t, shared.value) if isinstance(t, str) else (t, 0) for t in texts], columns=["text", "n"])

            out = out.withColumn("__c", clean("text")).withColumn("text", F.col("__c.text")).withColumn("removed_chars", F.col("removed_chars") + F.col("__c.n")).drop("__c")
        if batches <= 1:
            return out
        # A cut for one batch may join words to an n-gram of an earlier one.
        out = cut(out)
        if out.agg(F.sum("removed_chars")).first()[0] == before.agg(F.sum("removed_chars")).first()[0]:
            return out
