"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, inputs, release, text_keys, written
from .components import connected_components, refined
from .kernels import LOWER, RangeHash, chunks, joined, mix, sliced, words


BITMAP = 16


def _permuted(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The second permutation, of the 32-bit values; works in place on x."""
    np.right_shift(x, 16, out=out)
    x ^= out
    x *= np.uint32(0x7FEB352D)
    np.right_shift(x, 15, out=out)
    x ^= out
    x *= np.uint32(0x846CA68B)
    np.right_shift(x, 16, out=out)
    x ^= out
    return x


def circulant_signatures(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """size MinHash coordinates of each set of 64-bit values; set k is values[starts[k]:starts[k + 1]], none is empty.

    The first permutation scatters the values (their upper 32 bits after mixing); coordinate j is the least value of the
    second permutation after a circular shift by j. So two permutations give every coordinate.
    """
    out = np.empty((len(starts) - 1, size), np.uint32)
    scattered = (mix(values) >> np.uint64(32)).astype(np.uint32)
    first = 0
    while first < len(starts) - 1:  # blocks that stay in the CPU's cache
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + 30_000, "right")) - 1)
        block, at = scattered[starts[first] : starts[last]], starts[first:last] - starts[first]
        x, spare = np.empty_like(block), np.empty_like(block)
        for j in range(size):
            np.add(block, np.uint32(j), out=x)
            out[first:last, j] = np.minimum.reduceat(_permuted(x, spare), at)
        first = last
    return out


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles of `width` words (A-Z lower-cased), and each set's start.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    buf, at = joined(texts)
    buf = LOWER[buf]
    start, end = words(buf)
    hashes = RangeHash(buf).of(start, end)
    first = np.searchsorted(start, at)  # each text's first word
    n = len(hashes) - width + 1
    runs = hashes[: max(n, 0)].copy()
    for k in range(1, width):
        runs = mix(runs * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]) if n > 0 else runs
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            one = hashes[a : a + 1].copy()
            for k in range(a + 1, b):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + 1])
            sets.append(mix(one + np.uint64(b - a)))
        else:
            sets.append(hashes[:0])
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=starts[1:])
    return np.concatenate(sets) if sets else hashes[:0], starts


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, t0, t1, n_shingles, bands, bitmap) of inputs(); bands holds one 64-bit value for each band, none for an empty set.

    bitmap: BITMAP times 64 bits, set where the hash of one of the set's shingles falls.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            counts, keys, maps = [], [], []
            for a, b in chunks(texts):
                values, starts = shingle_sets(texts[a:b], width)
                n = np.diff(starts)
                some = np.append(starts[:-1][n > 0], len(values))
                sig = circulant_signatures(values, some, bands * rows).astype(np.uint64)
                key = np.full((len(some) - 1, bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for j in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows])
                bits = np.zeros((b - a, BITMAP * 64), np.uint8)
                bits[np.repeat(np.arange(b - a), n), (values % np.uint64(BITMAP * 64)).astype(np.int64)] = 1
                maps.append(np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel())
                counts.append(n)
                keys.append(key.view(np.int64).ravel())
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            offsets = np.zeros(len(n) + 1, np.int32)
            np.cumsum(np.where(n > 0, bands, 0), out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            fixed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BITMAP), pa.array(np.concatenate(maps) if maps else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("id", "t0", "t1")] + [pa.array(n, pa.int64()), lists, fixed], ["id", "t0", "t1", "n_shingles", "bands", "bitmap"])

    return docs.withColumns(text_keys(F.col("text"))).mapInArrow(sign, f"id {kind}, t0 long, t1 long, n_shingles long, bands array<long>, bitmap array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of pairs (a, b) whose texts' full shingle sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, set] = {}

        def shingles(node: int, text: str) -> set:
            if node not in known:
                if len(known) > 64:
                    known.clear()
                w = text.encode().lower().split()  # bytes: only A-Z, and only the six blanks
                known[node] = set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)}
            return known[node]

        for batch in sliced(batches):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for x, y, tx, ty in zip(a, b, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                p, q = shingles(x, tx), shingles(y, ty)
                both = len(p & q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(check, "a long, b long")


def _about(nodes: DataFrame) -> DataFrame:
    """(node, about) of nodes; about: the size n of the set, its bitmap, and hidden, by how much the set is larger than the bitmap's number of bits."""
    bits = sum((F.bit_count(F.get("bitmap", F.lit(k))) for k in range(BITMAP)), F.lit(0))
    return nodes.select("node", F.struct("n", "bitmap", (F.col("n") - bits).alias("hidden")).alias("about"))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether the sets of the nodes a and b (structs of _about) can be similar enough; only ever wrong by saying yes.

    A bit that only one bitmap has is an element that the other set lacks, so the common bits and the hidden elements bound the
    intersection from above. The sizes go first, as they are the cheaper test.
    """
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    both = (F.bit_count(F.get(f"{a}.bitmap", F.lit(k)).bitwiseAND(F.get(f"{b}.bitmap", F.lit(k)))) for k in range(BITMAP))
    most = sum(both, F.least(f"{a}.hidden", f"{b}.hidden"))
    return sizes & (most * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent)


def _shared(nodes: DataFrame) -> DataFrame:
    """(bucket, node, size, centre, about) of every bucket that several nodes share; centre: one of them, by the bucket's hash."""
    bucketed = nodes.select("node", F.explode("bands").alias("bucket"))
    mask = F.xxhash64("bucket")
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.col("node").bitwiseXOR(mask)).alias("least")).where("size > 1")
    shared = bucketed.join(sizes, "bucket").select("bucket", "node", "size", F.col("least").bitwiseXOR(mask).alias("centre"))
    return shared.join(_about(nodes), "node")


def _apart(members: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int, per_task: int) -> DataFrame:
    """(a, b), a < b: the pairs of members (node, label) with different labels that can be similar enough, by a prefix filter.

    Only shingles that several labels hold can be common to two of them. A node's are ordered from the rarest on; of a pair that is
    similar enough, the first common one has as many after it in both nodes as the similarity asks for, so the nodes meet at it.
    Of the labels of a shingle, nodes outside the largest meet all others, `per_task` nodes at a time in a task. Near copies that
    differ by words of their own have these in front, so a group of them that aren't similar enough gives few pairs to test.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [t.encode() for t in batch.column("text").to_pylist()]
            for a, b in chunks(found):
                values, starts = shingle_sets(found[a:b], width)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), batch.column("label").slice(a, b - a), lists], ["node", "label", "shingles"])

    held = texts.join(members, "node").select("node", "label", "text").mapInArrow(sets, "node long, label long, shingles array<long>")
    held = written(held.select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    shared = held.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    shared = written(shared.select("shingle", "holders"), "shared")  # counts are written before they are joined, so that Spark can split the join at a frequent shingle
    last_first = Window.partitionBy("node").orderBy(F.desc("holders"), F.desc("shingle"))
    front = held.join(shared, "shingle").withColumn("left", F.row_number().over(last_first)).where(F.col("left") * 100 >= F.col("n") * percent)
    front = written(front.select("shingle", "node", "label", "left"), "front")
    classes = front.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("shingle").agg(F.count("*").alias("classes"), F.sum("n").alias("members"), F.max(F.struct("n", "label"))["label"].alias("main")).where("classes > 1")
    mixed = written(mixed.select("shingle", "main", F.ceil(F.col("members") / per_task).cast("int").alias("parts")), "classes")
    known = written(front.join(mixed, "shingle").join(_about(nodes), "node"), "mixed")

    def side(df: DataFrame, k: str) -> DataFrame:
        return df.select("shingle", "part", *(F.col(x).alias(f"{x}_{k}") for x in ("node", "label", "main", "left", "about"))).withColumnRenamed(f"node_{k}", k)

    apart = side(known.where(F.col("label") != F.col("main")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "a")
    all_ = side(known.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "b")
    met = (F.col("left.shingle") == F.col("right.shingle")) & (F.col("left.part") == F.col("right.part")) & (F.col("label_a") != F.col("label_b"))
    met = met & ((F.col("label_b") == F.col("main_b")) | (F.col("a") < F.col("b")))  # of two nodes outside the main class one meets the other
    met = met & (F.least("left_a", "left_b") * (100 + percent) >= (F.col("about_a.n") + F.col("about_b.n")) * percent) & _possible("about_a", "about_b", percent)
    pairs = apart.repartition(tasks, "shingle", "part").alias("left").join(all_.repartition(tasks, "shingle", "part").alias("right"), met)
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "apart")
    for df in (held, shared, front, mixed, known):
        drop_written(df)
    return pairs


def _linked(sized: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int, all_pairs_up_to: int = 16, centres: int = 12, per_task: int = 512) -> DataFrame:
    """(node, label): components of the verified links between nodes of one bucket, as _shared() lists them.

    Buckets of at most all_pairs_up_to members give all their pairs. Each larger one has a member as its
    centre, and its members try at most `centres` of their buckets' centres; that connects nearly all of a large group of
    near copies with a few pairs a member. What is left are pairs of one bucket that aren't connected yet: the members of
    buckets with several classes of connected members meet by their rarest shingles (see _apart); no link is lost. A pair is
    verified only if its bitmaps allow the similarity, which the joins themselves check: pairs that don't are never rows.
    """
    about = _about(nodes)
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number keeps tasks of few bytes but many tests apart

    def side(df: DataFrame, k: str) -> DataFrame:
        return df.select("bucket", F.col("node").alias(k), F.col("about").alias(f"about_{k}"))

    low, high = sized.where(F.col("size") <= all_pairs_up_to).repartition(tasks, "bucket"), sized.where(F.col("size") > all_pairs_up_to)
    same, possible = (F.col("left.bucket") == F.col("right.bucket")) & (F.col("a") < F.col("b")), _possible("about_a", "about_b", percent)
    pairs = side(low, "a").alias("left").join(side(low, "b").alias("right"), same & possible).select("a", "b")

    pick = Window.partitionBy("node").orderBy(F.xxhash64("node", "centre"))
    stars = high.where(F.col("node") != F.col("centre")).groupBy("node", "centre").agg(F.first("about").alias("about_a"))
    stars = stars.withColumn("k", F.row_number().over(pick)).where(F.col("k") <= centres)
    stars = stars.join(about.select(F.col("node").alias("centre"), F.col("about").alias("about_b")), "centre")
    stars = stars.where(possible).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    tried = written(pairs.union(stars).distinct(), "pairs")
    links = written(verified(tried, texts, width, percent), "verified")
    if not high.limit(1).count():
        labels = connected_components(links)
        made = [sized, tried, links]
    else:
        early = connected_components(links, most_rounds=2)
        known = high.join(early, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        mixed = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
        members = written(known.join(mixed, "bucket").select("node", "label").distinct(), "members")
        rest = _apart(members, nodes, texts, width, percent, per_task)
        rest = written(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = written(verified(rest, texts, width, percent), "verified")
        labels = written(refined(early, links.union(more)), "labels")
        made = [sized, tried, links, early, members, rest, more]
    for df in made:
        drop_written(df)
    return labels


def _components(nodes: DataFrame, labels: DataFrame, hot: int = 1000) -> DataFrame:
    """(t0, t1, component_id) of every node. A label of over one in `hot` nodes, of which there are fewer than `hot`, is looked up in a broadcast table, so its nodes needn't meet in a task."""
    linked = nodes.select("node", "t0", "t1", "id").join(labels, "node", "left")
    alone = linked.where("label is null").select("t0", "t1", F.col("id").alias("component_id"))
    together = written(linked.where("label is not null").select("t0", "t1", "id", "label"), "labelled")
    groups = together.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    large = F.broadcast(groups.where(F.col("n") * hot > nodes.count()).select("label", F.struct("component_id").alias("of")))
    split = together.join(large, "label", "left")
    fast = split.where("of is not null").select("t0", "t1", "of.component_id")
    slow = split.where("of is null").join(groups, "label").select("t0", "t1", "component_id")
    return alone.union(fast).union(slow)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(id, n_shingles, component_id, kept, t0, t1) for every row; t0 and t1 are the text's key.

    Two texts are linked if the Jaccard similarity of their sets of `width`-word shingles is at least percent / 100;
    component_id is the smallest id that links reach, kept says that it is the row's own. A text without words (null
    too) is linked with nothing, and is kept. Rows that share an id share its verdict; a null id is never smallest, and
    a group of null ids alone has a null component and is kept.

    Equal texts become one node first, so groups of copies cost one row. Nodes that share a band (a pair at 0.8 misses
    all 40 bands of 5 with chance 1e-7) are candidates; candidates whose sizes rule the similarity out go, the rest are
    verified on full texts, without forming all pairs of a large group (see _linked).
    """
    texts = inputs(docs, id_col, text_col)
    signed = written(signatures(texts, width, bands, rows), "signed")
    nodes = signed.where("n_shingles > 0").groupBy("t0", "t1").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bitmap").alias("bitmap"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sized = written(_shared(nodes), "sized")
    wanted = nodes.select("node", "t0", "t1").join(sized.select("node").distinct(), "node", "left_semi")
    found = texts.withColumns(text_keys(F.col("text"))).join(wanted, ["t0", "t1"]).groupBy("node").agg(F.first("text").alias("text"))
    found = written(found, "texts")
    labels = _linked(sized, nodes, found, width, percent)
    verdict = _components(nodes, labels)
    out = signed.select("id", "t0", "t1", "n_shingles").join(verdict, ["t0", "t1"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = written(out.select("id", "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"), "t0", "t1"), "near_duplicates")
    for df in (signed, nodes, found, labels):
        drop_written(df)
    release(docs.sparkSession)
    return out
