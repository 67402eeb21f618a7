"""Similarity join of documents on word n-gram sets by MinHash banding.

Two texts are linked where the Jaccard similarity of their sets of n-word grams (lower-cased words
between white space) reaches the threshold. Equal word sequences collapse to one class text first,
so copies never meet in a bucket. Band and row counts follow from the wanted recall at the threshold;
the class texts are shuffled on band hashes, and every candidate pair is verified on full gram sets.

A bucket is never expanded into all its pairs. In a small one (at most `small` texts) each text meets
the others, a bounded number; in a larger one each text meets the bucket's two hubs (least and
greatest digest). Where verified hub links leave such a bucket in several components, all links that
can still join different components are found exactly: the texts of those buckets are joined on the
prefix of their grams in ascending order of frequency, which every pair at the threshold must share
(prefix filtering), and verified. Classes are the connected components of all verified links.

Links are counted, not listed. Linked texts have one component, so the texts of a component are dealt to
blocks, every two blocks meet in one task, and that task compares all their pairs on full gram sets and
gives out one number per text; the numbers of a text are summed. So every pair of a class counts, also
one that no band holds, whatever the size of its buckets.

Result, one row per document: id, class_id (least id of its class), n_copies (documents with the same
word sequence, itself included) and n_links (other texts of its class whose similarity to its text
reaches the threshold, each counted once).

Defined results: null, empty or blank texts have no grams, are never linked and form their own
classes; texts of fewer than n words have one gram, all their words; ids that repeat with one text
give one row, with several texts one row per text; rows with a null id are left out; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywick.llm.components import connected_components
from tallywick.llm.textcore import WordHasher, gram_hashes, mix, slices, texts
from tallywick.session import Scratch


#: Most texts (on average) and grams of a block; two blocks meet in a task.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 1 << 20
#: Gram columns that a task compares at once.
WIDTH = 4096
#: Rows of a bucket that are dealt to one task.
BUCKET_ROWS = 512


def plan_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall within `most` hashes.

    A pair at similarity s shares a band with probability 1 - (1 - s^rows)^bands.
    """
    best = None
    for rows in range(1, 33):
        bands = 1 if threshold >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def grams_of(hasher: WordHasher, text: str, n: int) -> tuple[bytes | None, np.ndarray]:
    """Digest of the word sequence (None without words) and the sorted set of gram hashes."""
    words = text.lower().split()
    if not words:
        return None, np.zeros(0, np.uint64)
    digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()
    return digest, np.unique(gram_hashes(hasher.ids(words), n))


def _signatures(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """id, digest, n_grams and the band hashes of every document."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, t) for c, t in (("digest", T.BinaryType()), ("n_grams", T.IntegerType()), ("bands", T.ArrayType(T.LongType()))))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches):
            sets = [grams_of(hasher, t, n) for t in texts(batch.column(1))]
            lengths = np.array([len(g) for _, g in sets], dtype=np.int64)
            full = np.flatnonzero(lengths)
            keys: list[list[int] | None] = [None] * len(sets)
            if len(full):
                grams = np.concatenate([sets[i][1] for i in full])
                starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
                least = np.empty((len(full), bands * rows), dtype=np.uint64)
                for j, a in enumerate(seeds):
                    least[:, j] = np.minimum.reduceat(grams * a, starts)
                of_band = np.zeros((len(full), bands), dtype=np.uint64)
                for r in range(rows):
                    of_band = mix(of_band + least[:, r::rows][:, :bands])
                of_band = mix(of_band + np.arange(bands, dtype=np.uint64)).astype(np.int64)
                for i, row in zip(full, of_band, strict=True):
                    keys[i] = row.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d for d, _ in sets], pa.binary()), pa.array(lengths.astype(np.int32)), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(id_col, text_col).filter(F.col(id_col).isNotNull()).mapInArrow(apply, schema)


def _gram_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """digest and its gram set as packed bytes, for the wanted (digest, id) rows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches):
            sets = [grams_of(hasher, t, n) for t in texts(batch.column(1))]
            same = [i for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)) if a == b[0]]
            yield pa.record_batch([pa.array([sets[i][0] for i in same], pa.binary()), pa.array([sets[i][1].tobytes() for i in same], pa.binary())], names=["digest", "grams"])

    rows = docs.select(id_col, text_col).join(wanted.select("digest", F.col("rep").alias(id_col)), id_col).select("digest", text_col)
    return rows.mapInArrow(apply, "digest binary, grams binary").dropDuplicates(["digest"])


def _verify(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose gram sets reach the threshold, with their similarity."""
    left, right = grams.select(F.col("digest").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("digest").alias("b"), F.col("grams").alias("gb"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                similar.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], names=["a", "b", "jaccard"])

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    return rows.mapInArrow(apply, "a binary, b binary, jaccard double").filter(F.col("jaccard") >= threshold)


def _near(x: str, y: str, threshold: float):
    """Sizes that a pair at the threshold can have."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(threshold)


def _crossing(mixed: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of different components by prefix filtering, over the texts of mixed buckets.

    mixed: (digest, label). With grams in one global order, two sets at the threshold share a gram
    among the first size - ceil(threshold * size) + 1 of each; the number of grams left from there on
    bounds what they can share, which drops most pairs of a group that miss the threshold.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = [np.frombuffer(g.as_buffer(), np.int64) for g in batch.column(2)]
            lengths = np.array([len(g) for g in sets])
            of = pa.array(np.repeat(np.arange(len(sets)), lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(lengths[of.to_numpy()].astype(np.int32)), pa.array(np.concatenate(sets))], names=["digest", "label", "size", "gram"])

    rows = mixed.join(grams, "digest").select("digest", "label", "grams").mapInArrow(unpack, "digest binary, label binary, size int, gram long")
    often = rows.groupBy("gram").agg(F.count("*").alias("df"))
    rare = rows.join(often.filter("df > 1"), "gram")
    # grams of one text only cannot be shared; they stand first in the order, so they shorten the prefix
    ranked = rare.groupBy("digest", "label", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    skipped = F.col("size") - F.size("g")
    length = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1 - skipped
    prefix = ranked.filter(length > 0).select("digest", "label", "size", skipped.alias("skipped"), F.posexplode(F.slice("g", F.lit(1), length.cast("int"))).alias("at", "x"))
    prefix = prefix.select("digest", "label", "size", "x.gram", (F.col("size") - F.col("skipped") - F.col("at")).alias("left"))
    other = prefix.select("gram", F.col("digest").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"), F.col("left").alias("rest"))
    # at a pair's first common gram, no more grams can be common than either has left
    enough = F.least("left", "rest") >= (F.col("size") + F.col("sb")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)
    met = prefix.join(other, "gram").filter((F.col("digest") < F.col("b")) & (F.col("label") != F.col("lb")) & _near("size", "sb", threshold) & enough)
    return met.select(F.col("digest").alias("a"), "b").distinct()


def common_grams(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common grams of the sets at `left` (rows) with those at `right` (columns)."""
    of = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    _, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = held[at] > 1  # grams of one set only are common to no pair
    of, at = of[more], (np.cumsum(held > 1) - 1)[at[more]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, WIDTH):
        a, b = np.searchsorted(at, [start, start + WIDTH])
        holds = np.zeros((len(sets), WIDTH), np.float32)
        holds[of[a:b], at[a:b] - start] = 1
        both += (holds[left] @ holds[right].T).astype(np.int64)
    return both


def _count_links(reps: DataFrame, grams: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """digest and n_links: the links of every text of a component to others of it."""

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in table.column("grams")]
        sizes, block = np.array([len(g) for g in sets]), table.column("block").to_numpy()
        left, right = (np.flatnonzero(block == k.as_py()) for k in key[1:])
        n_links = np.zeros(len(sets), np.int64)
        if len(left) and len(right):
            both = common_grams(sets, left, right)
            linked = both / (sizes[left][:, None] + sizes[right] - both) >= threshold
            if key[1] == key[2]:
                np.fill_diagonal(linked, False)
                n_links[left] = linked.sum(axis=1)
            else:
                n_links[left], n_links[right] = linked.sum(axis=1), linked.sum(axis=0)
        return pa.table({"digest": table.column("digest"), "n_links": pa.array(n_links)}).filter(pa.array(n_links > 0))

    rows = reps.select("digest", "n_grams").join(labels.select(F.col("node").alias("digest"), "label"), "digest")
    blocks = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g")).filter("n > 1")
    blocks = blocks.select("label", F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("g") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "label").select("digest", "label", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block"), "blocks").join(grams, "digest")
    meet = dealt.select("digest", "label", "block", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meet = meet.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "grams")
    return meet.groupBy("label", "i", "j").applyInArrow(count, "digest binary, n_links long").groupBy("digest").agg(F.sum("n_links").alias("n_links"))


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995, small: int = 16) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with their text's digest, class texts, verified links between class texts, gram sets).

    The links make all components, but are not all links: of large buckets they hold a part. The gram
    sets are those of all texts that have a link.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    bands, rows = plan_bands(threshold, recall)
    signed = scratch.save(_signatures(docs, id_col, text_col, n, bands, rows), "signatures")
    members = signed.select(id_col, "digest")
    reps = scratch.save(signed.filter("digest is not null").groupBy("digest", "n_grams", "bands").agg(F.min(id_col).alias("rep"), F.count("*").alias("n_copies")), "class-texts")
    banded = reps.select("digest", "n_grams", F.explode("bands").alias("bucket"))
    shared = scratch.save(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("digest", "n_grams")).alias("low"), F.max(F.struct("digest", "n_grams")).alias("high")).filter("n > 1"), "buckets")
    held = scratch.save(banded.join(shared, "bucket"), "members")
    few = held.filter(F.col("n") <= small).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("digest", "n_grams"))).alias("m"))
    few = few.select(F.col("m"), F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    hubs = held.filter(F.col("n") > small).select(F.struct("digest", "n_grams").alias("m"), F.explode(F.array("low", "high")).alias("h")).filter("m != h").select(F.least("m", "h").alias("x"), F.greatest("m", "h").alias("y"))
    pairs = few.unionByName(hubs).filter(_near("x.n_grams", "y.n_grams", threshold)).select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).distinct()
    pairs = scratch.save(pairs, "candidates")
    # a large bucket is dealt to several tasks wherever its rows meet something of the bucket
    share = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    large = held.filter(F.col("n") > small).select("bucket", "digest", F.pmod(F.xxhash64("digest"), share).alias("salt"))
    crowd = scratch.save(held.filter(F.col("n") > small).select("digest", "n_grams").distinct(), "crowd")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).union(crowd.select("digest")).distinct().join(reps.select("digest", "rep"), "digest")
    grams = scratch.save(_gram_sets(docs, wanted, id_col, text_col, n), "grams")
    links = scratch.save(_verify(pairs, grams, threshold), "links")
    labels = connected_components(links.select("a", "b"), scratch)
    named = labels.select(F.col("node").alias("digest"), "label")
    labelled = large.join(named, "digest", "left").select("bucket", "salt", "digest", F.coalesce("label", "digest").alias("label"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("salt").alias("salts")).filter("x != y")
    split = split.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts"))).alias("salt"))
    mixed = scratch.save(labelled.join(split, ["bucket", "salt"], "left_semi").select("digest", "label").distinct(), "mixed")
    if not mixed.isEmpty():
        more = _crossing(mixed, grams, threshold).join(pairs, ["a", "b"], "left_anti")
        links = links.unionByName(scratch.save(_verify(more, grams, threshold), "crossing"))
    return members, reps, links, grams


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, count_links: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(members, classes): id and digest of every row with an id, blank texts' digest null; and per
    digest its class_id, class_digest (the text that stands for the class), n_copies and n_links, which
    is 0 throughout where links are not to be counted."""
    members, reps, links, grams = ngram_links(docs, id_col, text_col, threshold=threshold, **options)
    scratch = Scratch(docs.sparkSession, "ngram-classes")
    labels = connected_components(links.select("a", "b"), scratch)
    named = reps.select("digest", "rep", "n_copies").join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left")
    if count_links:
        named = named.join(_count_links(reps, grams, labels, threshold), "digest", "left")
    else:
        named = named.withColumn("n_links", F.lit(0).cast("long"))
    named = scratch.save(named.select("digest", F.coalesce("label", "digest").alias("label"), "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    least = named.groupBy("label").agg(F.min(F.struct("rep", "digest")).alias("least"))
    classes = named.join(least, "label").select("digest", F.col("least.rep").alias("class_id"), F.col("least.digest").alias("class_digest"), "n_copies", "n_links")
    return members, scratch.save(classes, "classes")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, **options) -> DataFrame:
    """One row per document: id, class_id, n_copies, n_links (see the module)."""
    members, classes = ngram_classes(docs, id_col, text_col, threshold, **options)
    linked = members.filter("digest is not null").distinct().join(classes, "digest").select(id_col, "class_id", "n_copies", "n_links")
    blank = members.filter("digest is null").distinct().select(id_col, F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(blank)


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, **options) -> DataFrame:
    """The rows of docs that stand for their class: of every class of near copies the text that has its
    least id (of several the least digest), once.

    Rows are told apart by id and text, so of rows that repeat an id each unique text stays. Of rows
    equal in both, one stays, also where the text is blank. Rows with a null id stay as they are.
    """
    members, classes = ngram_classes(docs, id_col, text_col, threshold, count_links=False, **options)
    scratch = Scratch(docs.sparkSession, "ngram-kept")
    ids = members.groupBy(id_col).agg(F.count("*").alias("n"))
    repeated = scratch.save(ids.filter("n > 1").select(id_col), "repeated")
    gone = members.join(classes, "digest").filter(~((F.col(id_col) == F.col("class_id")) & (F.col("digest") == F.col("class_digest")))).select(id_col)
    once = docs.join(gone.unionByName(repeated).distinct(), id_col, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return once
    kept = classes.filter("digest = class_digest").select(F.col("class_id").alias(id_col), "digest")
    kept = kept.unionByName(members.filter("digest is null"))
    return once.unionByName(_texts_of(docs.join(repeated, id_col, "left_semi").select(docs.columns), kept, id_col, text_col))


def _texts_of(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for every (id, digest) of kept: of several the least by all columns' hash."""
    names, digest = docs.columns, "__digest"
    while digest in names:
        digest += "_"
    at = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(digest, T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches):
            found = pa.array([grams_of(hasher, t, 1)[0] for t in texts(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    rows = docs.mapInArrow(apply, schema)
    wanted = kept.distinct().select(F.col(id_col).alias(digest + "i"), F.col("digest").alias(digest + "d"))
    rows = rows.join(wanted, (F.col(id_col) == F.col(digest + "i")) & F.col(digest).eqNullSafe(F.col(digest + "d")), "left_semi")
    order = Window.partitionBy(id_col, digest).orderBy(F.xxhash64(*names), text_col)
    place = digest + "n"
    return rows.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(names)
