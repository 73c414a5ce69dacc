"""Same or near-same records across splits, by weighted cosine joins between the splits.

Copies are taken together first: a class is all samples of a split with the same value.
Exact overlap is a join of one-term vectors. For near overlap, a class (structure, 64-bit
hash) is a vector: the hash is cut into BLOCKS blocks, and each pair of blocks, with its
bits and the structure, is a term. Terms of a pair of blocks weigh as much as they are
rare, by the chance that two classes have the same bits there. Two hashes that differ in
at most 3 bits agree in at least three blocks, so share the three terms of these: their
cosine reaches the least weight of three such terms, the threshold of the join. The exact
cosine over single bits, 1 - differing bits / 64, then decides.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import fold_key, hex_to_long
from gridloom.llm.cosine_join import cosine_join
from gridloom.operators.nested import latest
from gridloom.session import cut, merged

#: Usual spellings of the roles, without case and anything but letters.
SPELLINGS = {
    "train": ("train", "training", "trainset", "trainingset", "trn"),
    "development": ("development", "dev", "devel", "devset", "developmentset", "validation", "valid", "val"),
    "holdout": ("holdout", "heldout", "holdoutset", "test", "testing", "testset"),
}
NEAR_BITS = 3
#: Blocks of a hash, and how many of them make a term.
BLOCKS, TOGETHER = 6, 2


def role_of(c: Column) -> Column:
    """train, development, holdout, or null for any other role."""
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    out = F.lit(None).cast("string")
    for role, names in SPELLINGS.items():
        out = F.when(letters.isin(*names), role).otherwise(out)
    return out


def hex_digits(c: Column) -> Column:
    """A hex value as a number's digits: without case, white space, prefix and leading zeros; null if it isn't hex or is zero."""
    digits = F.regexp_extract(fold_key(c), "^(?:sha256:|sha-256:|0x)?0*([1-9a-f][0-9a-f]*)$", 1)
    return F.when(digits != "", digits)


def signatures(table: DataFrame) -> DataFrame:
    """(sample, role, source_id, table_key, structure, bits) by each sample's latest registration; samples without one of the three roles are left out."""
    last = latest(table, "sample_id", "registered_at", ["role", "source_id", "perceptual_hash", "table_sha256", "structure_sha256"])
    bits = hex_digits(F.col("perceptual_hash"))
    return last.select(
        F.col("sample_id").alias("sample"),
        role_of(F.col("role")).alias("role"),
        "source_id",
        hex_digits(F.col("table_sha256")).alias("table_key"),
        hex_digits(F.col("structure_sha256")).alias("structure"),
        F.when(F.length(bits) <= 16, hex_to_long(bits)).alias("bits"),
    ).where("role is not null").withColumn("cls", class_id())


def class_id() -> Column:
    """24 bytes that stand for structure and hash on the way through the join: two digests of the structure, and the hash."""
    return F.when(F.col("structure").isNotNull() & F.col("bits").isNotNull(), F.struct(F.xxhash64("structure").alias("a"), F.xxhash64(F.lit(1), "structure").alias("b"), F.col("bits").alias("bits")))


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """Masks of the blocks of 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_terms(classes: DataFrame, name: str = "id") -> DataFrame:
    """(id, k, term) of classes (id: from ``class_id``): a term for each k-th choice of TOGETHER blocks. name: the column that stands for the id there."""
    masks = [sum(c) for c in combinations(block_masks(), TOGETHER)]
    terms = F.array(*[F.struct(F.lit(i).alias("k"), F.xxhash64("id.a", "id.b", F.lit(i), F.col("id.bits").bitwiseAND(F.lit(_signed(m)))).alias("term")) for i, m in enumerate(masks)])
    return classes.select(F.col(name).alias("id"), F.inline(terms))


def rarity(terms: DataFrame) -> list[float]:
    """The square of the weight of each choice of blocks; they sum to 1. By the chance that two classes have the same term: minus its logarithm."""
    n = len(list(combinations(range(BLOCKS), TOGETHER)))
    counts = terms.groupBy("k", "term").agg(F.count("*").alias("n")).groupBy("k").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("chance"))
    chance = {r.k: r.chance for r in counts.collect()}
    rare = [1.0 - math.log(chance.get(k, 1.0)) for k in range(n)]
    return [r / sum(rare) for r in rare]


def least_cosine(squares: list[float], near_bits: int = NEAR_BITS) -> float:
    """The least cosine of two hashes that differ in ``near_bits`` bits: that of the lightest choice of blocks left equal."""
    place = {c: i for i, c in enumerate(combinations(range(BLOCKS), TOGETHER))}
    return min(sum(squares[place[c]] for c in combinations(equal, TOGETHER)) for equal in combinations(range(BLOCKS), BLOCKS - near_bits))


def block_vectors(terms: DataFrame, squares: list[float]) -> DataFrame:
    """(id, term, weight)."""
    weight = F.element_at(F.array(*[F.lit(math.sqrt(x)) for x in squares]), F.col("k") + 1)
    return terms.select("id", "term", weight.alias("weight"))


def exact_classes(sigs: DataFrame) -> DataFrame:
    """(left_id, right_id): table values found both in train and in the other splits; both ids are the value."""
    side = lambda cond: sigs.where(cond).where("table_key is not null").select(F.col("table_key").alias("id")).distinct().select("id", F.col("id").alias("term"), F.lit(1.0).alias("weight"))
    return cosine_join(side("role = 'train'"), side("role != 'train'"), 1.0).select("left_id", "right_id")


def near_classes(sigs: DataFrame) -> DataFrame:
    """(left_id, right_id, distance): class ids of train and of the other splits with the same structure and hashes at most NEAR_BITS apart."""
    sides = sigs.where("cls is not null").select(F.col("cls").alias("id"), (F.col("role") == "train").alias("left")).distinct()
    # A structure of one split only has no partners: its classes are no vectors.
    both = sides.groupBy("id.a", "id.b").agg(F.countDistinct("left").alias("n")).where("n = 2").select(F.struct("a", "b").alias("structure"))
    sides = sides.withColumn("structure", F.struct("id.a", "id.b")).join(both, "structure", "left_semi").select("id", "left")
    # Numbers stand for the classes in the join: they take a fraction of the room of 15 copies of an id.
    sides = cut(sides.withColumn("number", F.monotonically_increasing_id()))
    squares = rarity(block_terms(sides, "number"))
    side = lambda left: block_vectors(block_terms(sides.where(F.col("left") == left), "number"), squares)
    met = cosine_join(side(True), side(False), least_cosine(squares)).select(F.col("left_id").alias("left_number"), F.col("right_id").alias("right_number"))
    for s in ("left", "right"):
        met = met.join(merged(sides.select(F.col("number").alias(f"{s}_number"), F.col("id").alias(f"{s}_id"))), f"{s}_number")
    apart = F.bit_count(F.col("left_id.bits").bitwiseXOR(F.col("right_id.bits")))
    return met.where("left_id.a = right_id.a and left_id.b = right_id.b").select("left_id", "right_id", apart.cast("int").alias("distance")).where(F.col("distance") <= NEAR_BITS)


def overlaps(table: DataFrame) -> DataFrame:
    """(train_sample, other_sample, overlap_kind, role, source_id, train_source_id): all pairs across splits.

    ``exact``: equal table value; else ``near``: equal structure and hashes at most
    NEAR_BITS bits apart. Values are compared as numbers; null, zero and broken values
    match nothing. Rows without sample_id are left out, repeated rows count once. role and
    source_id are the development or holdout sample's. Classes are joined, then expanded:
    the result holds every pair, so its size is that of the answer.
    """
    sigs = cut(signatures(table))
    train, other = sigs.where("role = 'train'"), sigs.where("role != 'train'")
    sides = {"left": train.select(F.col("sample").alias("train_sample"), F.col("source_id").alias("train_source_id"), F.col("table_key").alias("left_key"), F.col("structure").alias("left_structure"), F.col("cls").alias("left_id"))}
    sides["right"] = other.select(F.col("sample").alias("other_sample"), "role", "source_id", F.col("table_key").alias("right_key"), F.col("structure").alias("right_structure"), F.col("cls").alias("right_id"))
    out = ["train_sample", "other_sample", "overlap_kind", "role", "source_id", "train_source_id"]
    same = exact_classes(sigs).select(F.col("left_id").alias("left_key"), F.col("right_id").alias("right_key"))
    exact = same.join(merged(sides["left"].drop("left_id", "left_structure")), "left_key").join(merged(sides["right"].drop("right_id", "right_structure")), "right_key").withColumn("overlap_kind", F.lit("exact"))
    # The structures themselves are compared here, not their digests.
    near = near_classes(sigs).join(merged(sides["left"]), "left_id").join(merged(sides["right"]), "right_id").where("left_structure = right_structure and (left_key is null or right_key is null or left_key != right_key)").withColumn("overlap_kind", F.lit("near"))
    return exact.select(*out).unionByName(near.select(*out))


def overlap_counts(table: DataFrame) -> DataFrame:
    """(role, source_id, overlap_kind, n_pairs, n_samples): the pairs of ``overlaps``, and the development or holdout samples in them, per role and source of these.

    Counted from the sizes of classes, without forming the pairs: two classes with sizes a
    and b give a x b, less those pairs of them that are exact already.
    """
    sigs = cut(signatures(table))
    train, other = sigs.where("role = 'train'"), sigs.where("role != 'train'")
    by = ["role", "source_id"]
    out = [*by, "overlap_kind", "n_pairs", "n_samples"]
    keys = train.where("table_key is not null").groupBy("table_key").agg(F.count("*").alias("a"))
    same = exact_classes(sigs).select(F.col("left_id").alias("table_key"))
    exact = other.groupBy(*by, "table_key").agg(F.count("*").alias("b")).join(merged(keys.join(merged(same), "table_key", "left_semi")), "table_key")
    exact = exact.groupBy(*by).agg(F.sum(F.col("a") * F.col("b")).alias("n_pairs"), F.sum("b").alias("n_samples")).withColumn("overlap_kind", F.lit("exact"))
    # Per class of the other splits: samples of train near it, and of these those with each table value.
    near = cut(near_classes(sigs).select("left_id", "right_id"))
    held = near.join(merged(train.where("cls is not null").groupBy(F.col("cls").alias("left_id"), "table_key").agg(F.count("*").alias("a"))), "left_id").groupBy("right_id", "table_key").agg(F.sum("a").alias("a"))
    held = cut(held)
    total = held.groupBy("right_id").agg(F.sum("a").alias("total"))
    of_key = held.where("table_key is not null").select("right_id", F.col("table_key").alias("key"), "a")
    rows = other.where("cls is not null").groupBy(F.col("cls").alias("right_id"), *by, F.col("table_key").alias("key")).agg(F.count("*").alias("b"))
    rows = rows.join(merged(total), "right_id").join(merged(of_key), ["right_id", "key"], "left").withColumn("partners", F.col("total") - F.coalesce("a", F.lit(0)))
    counted = rows.where("partners > 0").groupBy(*by).agg(F.sum(F.col("partners") * F.col("b")).alias("n_pairs"), F.sum("b").alias("n_samples")).withColumn("overlap_kind", F.lit("near"))
    return exact.select(*out).unionByName(counted.select(*out))
