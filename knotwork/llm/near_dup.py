r"""Near-duplicate documents: SuperMinHash, banding, exact verification and grouping of linked documents.

A document's set is its distinct shingles of ``width`` words (``shingles.py``). Two documents are linked if
their sets overlap by ``percent`` of their union; groups are the connected components of all links.

1. One pass over the texts writes, per document, the size of its set, a 128-bit fingerprint of the set and the
   keys of ``bands`` bands of ``rows`` slots of its signature. The texts themselves are not shuffled.
2. Documents with equal sets form a class, named by a hash of its fingerprint; from here on classes stand for them. A
   group of any number of copies is one row after a grouped minimum.
3. Classes meet where a band agrees. In each bucket of two or more, every class is paired with one class there, its head, so
   pairs grow as the bucket, not as its square. The head is the member that shares most buckets, so it tends to be the text
   that the others vary. Each member's set is sent to its head's, which says how much they share and what the member has besides (its
   rest). Links found so are joined into components.
4. Classes of one head that are still in several components remain to be compared, across components only; pairs inside
   one can't change the result. A pair that shares buckets shares their heads, so comparing by head loses none. Of sets x and y under head h, at
   most min(|x & h|, |y & h|) elements are in h; so if y isn't in the head's component, x of a known range of sizes must share at least
   t = needed(x, y) - |y & h| elements of y's rest. Then one of any |rest| - t + 1 elements of y's rest is also in x's: y looks
   for its rarest ones among the rests of the other members (a prefix filter). Documents that vary one template without
   being near each other have rare elements of their own, and meet nobody. Only where t isn't positive, for y that is little more than a part of its head, does y meet
   all smaller members.
5. Pairs found so are first compared by sketches of four bits a slot of their signatures: a linked pair differs in more than ``DIFFER`` of 252 slots with a
   chance below one in ten million. The rest is verified on whole sets. Components of all links are the groups.

At similarity 0.8, a pair shares none of 42 bands of 6 slots with a chance of 3 in a million.

Cases. No words or null text: an empty set, linked with nothing. A null id, or one that is no integer: the row takes no part, its
component is null and it is kept. Rows that share an id are looked at one by one; of kept rows of one group that share its
id, ``drop_near_duplicates`` keeps one. Repeated rows: equal sets, one class. Extra columns pass through ``drop_near_duplicates``, whatever their names.
An empty table gives an empty result. A very long text is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from ..plans.storage import Table, materialise, scratch
from .common import by_bucket, map_batches, map_frames, mix64, own_name, whole_id
from .shingles import GOLDEN, SuperMinHash, band_keys, shingle_sets

BANDS, ROWS = 42, 6
#: Slots in which the sketches of a linked pair may differ; 64-bit words of a sketch.
DIFFER, WORDS = 86, 16
#: Counters of how often elements occur, and the ratio of sizes in one size class.
COUNTERS, SIZE_STEP = 1 << 17, 1.02
_U = np.uint64


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h"))


def class_name() -> Column:
    """A class's name, of its fingerprint and size: ids can stand for several texts."""
    return F.shiftrightunsigned(F.xxhash64("f1", "f2", "n_shingles"), 1)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over mixed elements: equal for equal sets, whatever their order."""
    pair = []
    for salt in (GOLDEN, ~GOLDEN):
        pair.append(np.array([mix64(s ^ salt).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64))
    return pair[0], pair[1]


def sketches(signed: np.ndarray) -> np.ndarray:
    """(sets x WORDS): four bits of each slot."""
    bits = np.zeros((len(signed), 16 * WORDS), np.uint64)
    bits[:, : signed.shape[1]] = signed & _U(15)
    return (bits.reshape(len(signed), WORDS, 16) << (_U(4) * np.arange(16, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)


def differing(x: str, y: str) -> Column:
    """The number of slots in which two sketches differ."""
    total = F.lit(0)
    for w in range(WORDS):
        z = F.get(x, F.lit(w)).bitwiseXOR(F.get(y, F.lit(w)))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        total = total + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, doc_id, h, n_shingles, f1, f2, keys, sketch) of each row of ``docs`` (doc_id, text, h); keys are null for empty sets, ``row`` is unique."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sign, row = SuperMinHash(bands * rows), TaskContext.get().partitionId() << 40
        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist(), width)
            signed = sign(sets)
            keys = band_keys(signed, bands, rows).view(np.int64)
            f1, f2 = fingerprints(sets)
            row += len(pdf)
            yield pd.DataFrame({"row": np.arange(row - len(pdf), row), "doc_id": pdf["doc_id"], "h": pdf["h"], "n_shingles": [len(s) for s in sets], "f1": f1, "f2": f2, "keys": [k if len(s) else None for k, s in zip(keys, sets, strict=True)], "sketch": list(sketches(signed))})

    return map_frames(docs, run, "row long, doc_id long, h long, n_shingles long, f1 long, f2 long, keys array<long>, sketch array<long>", "text", 1 << 20)


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """(v, n, set) of each row of ``docs`` (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist(), width)
            f1, f2 = fingerprints(sets)
            yield pd.DataFrame({"n_shingles": [len(s) for s in sets], "f1": f1, "f2": f2, "set": [s.view(np.int64) for s in sets]})

    made = map_frames(docs.select("text"), run, "n_shingles long, f1 long, f2 long, set array<long>", "text", 1 << 20)
    return made.select(class_name().alias("v"), F.col("n_shingles").alias("n"), "set")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes na and nb of their sets, the sets, and how many elements they share; b's set goes to a's."""
    left = sets.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    return pairs.join(right, "b").join(left, "a").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))


def needed(na: Column, nb: Column, percent: int) -> Column:
    """The least number of shared elements of two linked sets of these sizes."""
    return F.ceil(percent * (na + nb) / (100 + percent) - 1e-6)


def linked(met: DataFrame, percent: int) -> DataFrame:
    return met.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def likely(pairs: DataFrame, known: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of ``known`` (v, n, sketch) don't rule out."""
    x, y = known.toDF("a", "na", "xs"), known.toDF("b", "nb", "ys")
    met = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    most = DIFFER * bands * rows / 252 if percent == 80 else bands * rows * (1 - percent / 100 + 0.16)
    return met.where(differing("xs", "ys") <= most).select("a", "b")


def size_class(n: Column | np.ndarray) -> Column | np.ndarray:
    if isinstance(n, Column):
        return F.floor(F.log(n) / F.lit(float(np.log(SIZE_STEP)))).cast("long")
    return np.floor(np.log(n) / np.log(SIZE_STEP)).astype(np.int64)


def _cell(head: int, size: int, elements: np.ndarray) -> np.ndarray:
    """One key for a head, a size class and each of some elements."""
    own = mix64(np.array([head], np.int64).view(np.uint64) + np.array([size + 1], np.int64).view(np.uint64) * GOLDEN)
    return mix64(elements.view(np.uint64) ^ own).view(np.int64)


def _counter(head: int, elements: np.ndarray) -> np.ndarray:
    return (_cell(head, -1, elements).view(np.uint64) >> _U(20)).astype(np.int64) % COUNTERS


def rarity(open_members: DataFrame) -> np.ndarray:
    """How often the elements of each counter occur in the rests of ``open_members``; a fixed number of counters comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            rests = batch.column("rest")
            for i, head in enumerate(batch.column("head").to_pylist()):
                total += np.bincount(_counter(head, rests[i].values.to_numpy()), minlength=COUNTERS) if len(rests[i].values) > COUNTERS else 0
                if len(rests[i].values) <= COUNTERS:
                    np.add.at(total, _counter(head, rests[i].values.to_numpy()), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([used, total[used]], names=["counter", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in map_batches(open_members.select("head", "rest"), run, "counter long, n long").groupBy("counter").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def meeting_keys(open_members: DataFrame, percent: int) -> DataFrame:
    """(key, v, c, asks): under which keys members can be found by their rests, and for members outside their head's component, look for others.

    ``open_members``: head, v, n, c, outside, shared (with the head), rest, sizes (the size classes under the head, sorted).
    """
    spark = open_members.sparkSession
    counted = spark.sparkContext.broadcast(rarity(open_members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = counted.value
        for batch in batches:
            rests, classes = batch.column("rest"), batch.column("sizes")
            rows = zip(*[batch.column(x).to_pylist() for x in ("head", "v", "n", "c", "outside", "shared")], strict=True)
            keys, vs, cs, asks = [], [], [], []
            total = 0

            def put(found: np.ndarray, v: int, c: int, ask: bool) -> None:
                nonlocal total
                keys.append(found)
                vs.append(np.full(len(found), v))
                cs.append(np.full(len(found), c))
                asks.append(np.full(len(found), ask))
                total += len(found)

            def out() -> pa.RecordBatch:
                nonlocal total
                made = pa.RecordBatch.from_arrays([np.concatenate(x) for x in (keys, vs, cs, asks)], names=["key", "v", "c", "asks"])
                for x in (keys, vs, cs, asks):
                    x.clear()
                total = 0
                return made

            for i, (head, v, n, c, outside, shared) in enumerate(rows):
                rest = rests[i].values.to_numpy()
                put(_cell(head, int(size_class(np.float64(n))), rest), v, c, False)
                if outside and len(rest):
                    order = np.lexsort((rest, rare[_counter(head, rest)]))
                    for size in classes[i].as_py():
                        low, high = np.ceil(SIZE_STEP**size - 1e-6), SIZE_STEP ** (size + 1)
                        if high * 100 < percent * n or low * percent > 100 * n:
                            continue
                        least = int(np.ceil(percent * (n + max(low, percent * n / 100)) / (100 + percent) - 1e-6)) - shared
                        if 1 <= least <= len(rest):
                            put(_cell(head, size, rest[order[: len(rest) - least + 1]]), v, c, True)
                if total > 1 << 18:
                    yield out()
            if keys:
                yield out()

    return map_batches(open_members.select("head", "v", "n", "c", "outside", "shared", "rest", "sizes"), run, "key long, v long, c long, asks boolean")


def across(open_members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one head and different components that what is known from the head doesn't rule out."""
    keys = materialise(meeting_keys(open_members, percent), "keys")
    ask, held = keys.where("asks").toDF("key", "a", "ca", "asks"), keys.where("not asks").toDF("key", "b", "cb", "held")
    found = ask.join(held, "key").where("ca <> cb").select("a", "b")
    # those for which the least number isn't positive for some smaller size
    own = F.col("n"), F.col("shared")
    lone = open_members.where(F.col("outside")).select("head", F.col("v").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("shared").alias("sa"), F.explode("sizes").alias("size"))
    low = F.greatest(F.ceil(F.pow(F.lit(SIZE_STEP), F.col("size").cast("double")) - 1e-6).cast("double"), F.col("na") * percent / 100)
    high = F.pow(F.lit(SIZE_STEP), F.col("size").cast("double") + 1)
    lone = lone.where((high * 100 >= percent * F.col("na")) & (low * percent <= 100 * F.col("na"))).where(needed(F.col("na"), low, percent) - F.col("sa") < 1)
    others = open_members.select("head", size_class(own[0]).alias("size"), F.col("v").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("shared").alias("sb"))
    met = lone.join(others, ["head", "size"]).where("ca <> cb")
    met = met.where(needed(F.col("na"), F.col("nb"), percent) <= F.least("sa", "sb") + F.least(F.col("na") - F.col("sa"), F.col("nb") - F.col("sb"))).select("a", "b")
    return found.union(met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bucket_heads(met: DataFrame) -> DataFrame:
    """(key, head): of each bucket of ``met`` (key, v, size), the member that shares most buckets with others, smallest id first."""
    known = met.groupBy("v").agg(F.sum(F.col("size") - 1).alias("fame"))
    ranked = met.select("key", "v").join(known, "v")
    return ranked.groupBy("key").agg(F.max(F.struct("fame", (-F.col("v")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("head"))


def _groups(docs: DataFrame, width: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h, n_shingles, grouped (a name of the row's group, null if it takes no part), component_id, kept, per row of ``docs`` (doc_id, text, h)."""
    with scratch() as own:
        signed = own.keep(Table(signatures(docs, width, bands, rows), "signatures"))
        usable = signed.df.where("doc_id is not null and n_shingles > 0").withColumn("v", class_name())
        classes = materialise(usable.groupBy("v").agg(F.min(F.struct("doc_id", "h", "row")).alias("first")).select("v", "first.doc_id", "first.h", "first.row"), "classes")

        heads = usable.join(classes, "row", "left_semi")
        banded = heads.select("v", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
        buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = Table(banded.join(materialise(buckets, "buckets"), "key"), "met")
        members = materialise(met.df.join(bucket_heads(met.df), "key").select("head", "v", "n").distinct(), "members")
        met.drop()
        starred = members.where("v <> head").select(F.col("head").alias("a"), F.col("v").alias("b"))

        involved = materialise(classes.join(members.select("v").distinct(), "v", "left_semi"), "involved")
        wanted = by_bucket(docs, "doc_id", involved.select("doc_id"))[0].join(involved.select("doc_id", "h"), ["doc_id", "h"], "left_semi")
        once = wanted.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
        sets = materialise(whole_sets(once, width), "sets")
        seen = materialise(overlaps(starred, sets).select("a", "b", "na", "nb", "shared", F.array_except("sb", "sa").alias("rest")), "seen")
        links = linked(seen, percent)

        first = materialise(stars(links), "placed")
        placed = members.join(first, "v", "left").select("head", "v", "n", F.coalesce("component", "v").alias("c"))
        mixed = materialise(placed.groupBy("head").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.when(F.col("v") == F.col("head"), F.col("c"))).alias("hc"), F.sort_array(F.collect_set(size_class(F.col("n")))).alias("sizes")).where("low < high"), "mixed")
        profile = seen.select(F.col("a").alias("head"), F.col("b").alias("v"), "shared", "rest")
        opened = placed.join(mixed.select("head", "hc", "sizes"), "head").join(profile, ["head", "v"], "left")
        none = F.array().cast("array<long>")
        opened = opened.select("head", "v", "n", "c", (F.col("c") != F.coalesce("hc", F.lit(-1))).alias("outside"), F.coalesce("shared", "n").alias("shared"), F.coalesce("rest", none).alias("rest"), "sizes")
        opened = materialise(opened, "open")
        known = heads.select("v", F.col("n_shingles").alias("n"), "sketch")
        pairs = materialise(likely(across(opened, percent), known, percent, bands, rows), "pairs")
        more = linked(overlaps(pairs, sets), percent)
        groups = stars(links.union(more))

        named = materialise(classes.join(groups, "v", "left").select("v", "doc_id", F.col("component").isNotNull().alias("tied"), F.coalesce("component", "v").alias("grouped")), "named")
        heads_of = groups.select(F.col("component").alias("v")).distinct()
        tied = named.where("tied").unionByName(named.join(heads_of, "v", "left_semi").where("not tied"))
        least = tied.groupBy("grouped").agg(F.min("doc_id").alias("low"))
        labelled = own.result(named.join(least, "grouped", "left").select("v", "grouped", F.coalesce("low", "doc_id").alias("component")), "grouped")
    of_row = signed.df.withColumn("v", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), class_name())).join(labelled, "v", "left")
    component = F.coalesce("component", "doc_id")
    return of_row.select("doc_id", "h", "n_shingles", "grouped", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group), kept (whether that is this id), per row."""
    return _groups(_slim(docs, id_col, text_col), width, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, of its smallest id; rows go by id and text, as ids may repeat."""
    id_, hash_ = own_name(docs, "id"), own_name(docs, "hash")
    with scratch() as scope:
        found = materialise(_groups(_slim(docs, id_col, text_col), width, percent).where("grouped is not null"), "groups")
        own = found.where("kept").groupBy("grouped", "doc_id").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("copies"))
        stays = own.select("doc_id", "h", "grouped")
        gone = scope.result(found.where("not kept").select("doc_id", "h").union(found.where("kept").join(stays, ["doc_id", "h", "grouped"], "left_anti").select("doc_id", "h")).toDF(id_, hash_).distinct(), "gone")
        again = scope.result(own.where("copies > 1").select(F.col("doc_id").alias(id_), F.col("h").alias(hash_)), "again")
    maybe, stay = by_bucket(docs, id_col, gone.select(id_).union(again.select(id_)))
    keyed = maybe.withColumn(id_, whole_id(maybe, id_col)).withColumn(hash_, F.xxhash64(F.col(f"`{text_col}`").cast("string"))).join(gone, [id_, hash_], "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(again, [id_, hash_], "left_semi").dropDuplicates([id_, hash_])
    return stay.unionByName(keyed.join(again, [id_, hash_], "left_anti").select(*names)).unionByName(once.select(*names))
