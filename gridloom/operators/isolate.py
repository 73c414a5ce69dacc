"""Split isolation: exact, family and near overlaps between roles, and duplicate components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.text import fold_key, hex_to_long
from gridloom.session import cut

# The signals of a signature.
SIGNALS = ("image_sha256", "pixel_sha256", "table_sha256", "structure_sha256", "text_sha256", "geometry_sha256")
#: Signals whose equality across roles is an overlap; the others are only counted.
HARD_SIGNALS = ("image_sha256", "pixel_sha256", "table_sha256")
SAMPLES_SHOWN = 8
NEAR_BITS = 2


def digest(c: Column) -> Column:
    """A digest without case, white space and prefix; null for null, empty and all-zero ones."""
    plain = F.regexp_replace(fold_key(c), "^(sha256:|0x)", "")
    return F.when(plain.rlike("[^0]"), plain)


def role_name(c: Column) -> Column:
    """A role without case and surrounding white space."""
    return fold_key(c)


def signature_rows(table: DataFrame, latest) -> DataFrame:
    """(sample_id, role, digests, hash, families) of each sample's latest registration."""
    cols = ["role", "perceptual_hash", *SIGNALS, "families"]
    rows = latest(table.withColumn("families", F.array_sort(F.map_entries("families"))), "sample_id", "registered_at", cols)
    return rows.select("sample_id", role_name(F.col("role")).alias("role"), digest(F.col("perceptual_hash")).alias("perceptual_hash"), *[digest(F.col(s)).alias(s) for s in SIGNALS], F.map_from_entries("families").alias("families"))


def _long(sigs: DataFrame, signals) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in signals])
    return sigs.select("sample_id", "role", F.inline(entries)).where("value is not null")


def exact_overlaps(sigs: DataFrame) -> DataFrame:
    """(signal, value, roles, sample_ids): values of hard signals found in more than one role, with the first samples by id.

    Roles are gathered as a set and the samples cut to a top-k before the shuffle, so a
    value held by a third of all rows needs no more memory than any other.
    """
    rows = _long(sigs, HARD_SIGNALS)
    met = rows.groupBy("signal", "value").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct("role").alias("n")).where("n > 1").drop("n")
    shown = _first_samples(rows.join(met.select("signal", "value"), ["signal", "value"], "left_semi"))
    return met.join(shown, ["signal", "value"])


def _first_samples(rows: DataFrame) -> DataFrame:
    """The first SAMPLES_SHOWN ids of each value. A rank with a limit is cut down in every partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("signal", "value").orderBy("sample_id"))
    first = rows.select("signal", "value", "sample_id").withColumn("rank", rank).where(F.col("rank") <= SAMPLES_SHOWN)
    return first.groupBy("signal", "value").agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("sample_ids"))


def family_overlaps(sigs: DataFrame) -> DataFrame:
    """(signal, value, roles): family ids found in more than one role."""
    rows = sigs.select("role", F.explode("families").alias("signal", "value")).where("value is not null")
    return rows.groupBy("signal", "value").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.countDistinct("role").alias("n")).where("n > 1").drop("n")


def duplicate_members(sigs: DataFrame) -> DataFrame:
    """(signal, n_members): samples whose value of a signal is shared with another sample."""
    sizes = _long(sigs, SIGNALS).groupBy("signal", "value").count()
    return sizes.groupBy("signal").agg(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("n_members"))


_CLASS = ("role", "bits", "text_sha256", "structure_sha256", "geometry_sha256")


def near_classes(sigs: DataFrame, near_bits: int = NEAR_BITS) -> DataFrame:
    """(a, b, distance, text_same, grid_same): pairs of classes, a's role before b's, with hashes at most ``near_bits`` apart and equal text, or equal structure and geometry.

    A class, the struct of _CLASS, is all samples of a role that agree in these. Only equal
    texts, or equal structures with equal geometry, are ever compared: two joins on those
    blocks, cut further by a term of the hash - of near_bits + 1 blocks of bits two near
    hashes have one in common. Each pair once.
    """
    rows = sigs.where("perceptual_hash is not null and role is not null").withColumn("bits", hex_to_long(F.col("perceptual_hash"))).select(F.struct(*_CLASS).alias("c")).distinct()
    edges = [round(64 * i / (near_bits + 1)) for i in range(near_bits + 2)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    terms = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("c.bits").bitwiseAND(F.lit(m)).alias("b")) for i, m in enumerate(signed)]))
    found = None
    for block in (["text_sha256"], ["structure_sha256", "geometry_sha256"]):
        keyed = rows.where(" and ".join(f"c.{c} is not null" for c in block)).withColumn("term", terms)
        keys = [F.col(f"c.{c}").alias(f"k{i}") for i, c in enumerate(block)]
        on = [f"k{i}" for i in range(len(block))] + ["term"]
        met = keyed.select(*keys, "term", F.col("c").alias("a")).join(keyed.select(*keys, "term", F.col("c").alias("b")), on).where("a.role < b.role")
        near = met.withColumn("distance", F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))).where(F.col("distance") <= near_bits).select("a", "b", "distance")
        found = near if found is None else found.unionByName(near)
    same = lambda *cs: F.coalesce(F.expr(" and ".join(f"a.{c} = b.{c}" for c in cs)), F.lit(False))
    return found.distinct().select("a", "b", "distance", same("text_sha256").alias("text_same"), same("structure_sha256", "geometry_sha256").alias("grid_same"))


def _of_class(sigs: DataFrame) -> DataFrame:
    return sigs.where("perceptual_hash is not null and role is not null").withColumn("bits", hex_to_long(F.col("perceptual_hash"))).withColumn("c", F.xxhash64(*_CLASS))


def near_overlaps(sigs: DataFrame, near_bits: int = NEAR_BITS) -> DataFrame:
    """(first, second, distance, text_same, grid_same): the pairs of samples of ``near_classes``, each once, the lesser sample first. As many rows as there are pairs; ``near_classes`` has one per pair of classes."""
    pairs = near_classes(sigs, near_bits).withColumn("ca", F.xxhash64(*[f"a.{c}" for c in _CLASS])).withColumn("cb", F.xxhash64(*[f"b.{c}" for c in _CLASS]))
    held = _of_class(sigs)
    side = lambda x: held.select(F.col("c").alias(f"c{x}"), F.struct(*_CLASS).alias(f"{x}2"), F.col("sample_id").alias(f"s{x}"))
    met = pairs.join(side("a"), "ca").join(side("b"), "cb").where("a <=> a2 and b <=> b2")
    return met.select(F.least("sa", "sb").alias("first"), F.greatest("sa", "sb").alias("second"), "distance", "text_same", "grid_same")


def near_count(sigs: DataFrame, near_bits: int = NEAR_BITS) -> DataFrame:
    """One row (n): how many pairs ``near_overlaps`` has, from the sizes of the classes."""
    sizes = _of_class(sigs).groupBy(F.struct(*_CLASS).alias("k")).agg(F.count("*").alias("n"))
    code = lambda x: F.xxhash64(*[f"{x}.{c}" for c in _CLASS])
    pairs = near_classes(sigs, near_bits).withColumn("ca", code("a")).withColumn("cb", code("b"))
    side = lambda x: sizes.select(code("k").alias(f"c{x}"), F.col("k").alias(f"{x}2"), F.col("n").alias(f"n{x}"))
    met = pairs.join(side("a"), "ca").join(side("b"), "cb").where("a <=> a2 and b <=> b2")
    return met.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("n"))


def audit(sigs: DataFrame, near_bits: int = NEAR_BITS) -> DataFrame:
    """One row: n_signatures, n_exact, n_family, n_near, status (PASS if no overlap)."""
    parts = {"n_signatures": sigs, "n_exact": exact_overlaps(sigs), "n_family": family_overlaps(sigs), "n_near": near_count(sigs, near_bits)}
    counts = None
    for name, df in parts.items():
        n = (df if name == "n_near" else df.agg(F.count("*").alias("n"))).withColumn("name", F.lit(name))
        counts = n if counts is None else counts.unionByName(n)
    row = counts.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])
    return row.withColumn("status", F.when(F.col("n_exact") + F.col("n_family") + F.col("n_near") == 0, "PASS").otherwise("FAIL"))


def duplicate_components(sigs: DataFrame, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """(sample_id, component, component_size) over samples that share a value of any signal; component is its least sample.

    Labels travel through the values: each round every value takes the least label of its
    samples and every sample the least label of its values, both aggregated before the
    shuffle; labels are then followed to their own labels. Lineage is cut every round.
    """
    rows = _long(sigs, signals).withColumn("value", F.concat("signal", F.lit(":"), "value")).select("sample_id", "value").distinct()
    shared = rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    links = cut(rows.join(shared, "value", "left_semi"))
    labels = cut(sigs.select("sample_id", F.col("sample_id").alias("label")))
    while True:  # ends: labels only ever become less
        by_value = links.join(labels, "sample_id").groupBy("value").agg(F.min("label").alias("least"))
        by_sample = links.join(by_value, "value").groupBy("sample_id").agg(F.min("least").alias("least"))
        lower = labels.join(by_sample, "sample_id", "left").select("sample_id", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        up = lower.where("label != sample_id").select(F.col("sample_id").alias("label"), F.col("label").alias("up"))
        after = cut(lower.join(up, "label", "left").select("sample_id", "was", F.least("label", "up").alias("label")))
        labels = after.select("sample_id", "label")
        if after.where("label != was").isEmpty():
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("component_size"))
    return labels.join(sizes, "label").select("sample_id", F.col("label").alias("component"), "component_size")


def pair_completeness(records: DataFrame) -> DataFrame:
    """(pair_id, n, complete): counterfactual pairs and whether they are two records of one role with one gold state.

    records: (sample_id, pair_id, role, gold_sha); records without pair are left out.
    """
    same = (F.col("n") == 2) & (F.col("roles") == 1) & (F.col("golds") == 1)
    return records.where("pair_id is not null").groupBy("pair_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("roles"), F.countDistinct("gold_sha").alias("golds")).select("pair_id", "n", same.alias("complete"))


def role_counts(records: DataFrame, *by: str) -> DataFrame:
    """Counts by each of ``by``, by all of them, and overall, in one pass; columns not grouped by are null, ``level`` tells them apart."""
    rolled = records.groupingSets([[c] for c in by] + [list(by), []], *by)
    return rolled.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))
