"""SimHash near-duplicates of documents: generalised pigeonhole search over fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, only_row, pick, stage, with_row
from .components import connected_components
from .similar import similar_dedup

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 2, 42
#: Most fingerprints of a bucket that are compared with each other; larger buckets are split first.
BUCKET = 2048
#: Cost of a probe key, in compared pairs.
KEY_COST = 8.0
#: Bytes of text of a chunk, and shingles of one whose hashes are spread to 64 bytes each at once.
CHUNK, SHINGLES = 1 << 20, 1 << 17


def fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch, texts in chunks(batches, most=CHUNK):
        words = Words(texts, lower=True)
        total = np.diff(words.first)
        # Shingles of each text; a shorter text is one.
        heads = np.maximum(total - shingle + 1, (total > 0).astype(np.int64))
        head = np.cumsum(heads) - heads
        text = words.text
        ones = np.zeros((len(texts), BITS), dtype=np.int32)
        for a in range(0, int(heads.sum()), SHINGLES):
            at = np.arange(a, min(a + SHINGLES, int(heads.sum())))
            doc = np.searchsorted(head + heads, at, side="right")
            first = words.first[doc] + at - head[doc]
            last = np.minimum(first + shingle, words.first[doc + 1]) - 1
            hashes = np.fromiter(
                (digest(text[x:y], SEED) for x, y in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)),
                dtype=np.uint64,
                count=len(at),
            )
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            new = np.flatnonzero(np.diff(doc, prepend=-1))
            ones[doc[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
        major = np.packbits(2 * ones > heads[:, None], axis=1, bitorder="little")
        out = np.ascontiguousarray(major).view("<u8").ravel()
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "version": batch.column("version"), "fp": pa.array(out.view(np.int64), pa.int64())})


def bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many fingerprints have both of two bits, for each pair of bits."""
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        values = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
        bits = np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += (bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": total.ravel()})


def partitions(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Splits the bits into `parts` groups of equal size, correlated bits together."""
    left, out = set(range(len(correlation))), []
    for k in range(parts):
        size = len(left) // (parts - k)
        strength = correlation[np.ix_(sorted(left), sorted(left))].sum(axis=1)
        group = [sorted(left)[int(np.argmax(strength))]]
        left.remove(group[0])
        while len(group) < size:
            rest = sorted(left)
            best = rest[int(np.argmax(correlation[np.ix_(rest, group)].sum(axis=1)))]
            group.append(best)
            left.remove(best)
        out.append(group)
    return out


def mask_of(bits: list[int]) -> int:
    """The mask with these bits, as a signed 64-bit integer."""
    return int(np.array(sum(1 << b for b in bits), dtype=np.uint64).astype(np.int64))


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Cheapest thresholds t of the partitions with sum(t + 1) = distance + 1; -1 leaves one out.

    costs[i][t]: of probing partition i with threshold t. Two fingerprints at most `distance` apart are
    within t of each other in some partition: else they'd differ by sum(t + 1) > distance bits.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (sum_, chosen) in best.items():
            for t in range(-1, distance - used + 1):
                new = (sum_ + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if used + t + 1 not in step or new[0] < step[used + t + 1][0]:
                    step[used + t + 1] = new
        best = step
    return best[distance + 1]


def probe_masks(distinct: DataFrame, distance: int) -> list[int]:
    """Masks such that any two fingerprints at most `distance` bits apart agree under one of them.

    Bit correlations and the number of pairs that agree in a partition are counted over all
    fingerprints; pairs within a wider threshold are estimated from them and the bits' frequencies.
    """
    counts = np.zeros((BITS, BITS))
    for row in distinct.mapInArrow(bit_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        counts[row["i"], row["j"]] = row["n"]
    total = distinct.count()
    if total < 2:
        return []
    share = np.diag(counts) / total
    spread = np.sqrt(share * (1 - share))
    correlation = np.abs(counts / total - np.outer(share, share)) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(correlation, 0)
    same = share**2 + (1 - share) ** 2
    choices = {m: partitions(correlation, m) for m in range(2, distance + 3)}
    named = {(m, i): bits for m, parts in choices.items() for i, bits in enumerate(parts)}
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask_of(bits))).alias("v")) for (m, i), bits in named.items()])).alias("k")
    pairs = {
        (r["m"], r["i"]): float(r["pairs"])
        for r in distinct.select(keys).groupBy("k.m", "k.i", "k.v").count().groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    }
    found = []
    for m, parts in choices.items():
        costs = []
        for i, bits in enumerate(parts):
            odds = (1 - same[bits]) / same[bits]
            one, two = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
            pairs0 = pairs[m, i] + total * total / 2.0 ** (len(bits) + 1) * 1e-3
            wide = [1.0, 1 + one, 1 + one + two]
            ways = [1, len(bits), len(bits) * (len(bits) - 1) // 2]
            costs.append([KEY_COST * total * ways[t] + pairs0 * wide[t] for t in range(min(distance, 2) + 1)] + [float("inf")] * max(0, distance - 2))
        found.append((*allocate(costs, distance), m))
    _, thresholds, m = min(found)
    masks = []
    for bits, t in zip(choices[m], thresholds, strict=True):
        if t == 0:
            masks.append(mask_of(bits))
        elif t == 1:
            masks += [mask_of([b for b in bits if b != x]) for x in bits]
        elif t == 2:
            masks += [mask_of([b for b in bits if b not in (x, y)]) for k, x in enumerate(bits) for y in bits[k + 1 :]]
    return masks


def finer(mask: int, distance: int) -> list[int]:
    """Masks that extend `mask`: of two fingerprints that agree under it and are near, one keeps both."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask_of([b for b in range(BITS) if mask >> b & 1] + rest[k :: distance + 1]) for k in range(distance + 1)]


def near_pairs(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """For each bucket, links that connect what its near fingerprints connect, at most one per member."""
    for batch in batches:
        one, two = [], []
        for values in batch.column("fps").to_pylist():
            fps = np.array(values, dtype=np.int64)
            n = len(fps)
            root = list(range(n))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a in range(n - 1):
                near = np.flatnonzero(np.bitwise_count((fps[a + 1 :] ^ fps[a]).view(np.uint64)) <= distance)
                for b in near.tolist():
                    x, y = find(a), find(a + 1 + b)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        one.append(int(fps[a]))
                        two.append(int(fps[a + 1 + b]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})


def hamming_links(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `fp` at most `distance` bits apart.

    Fingerprints meet in buckets of equal bits under the masks of `probe_masks`; a bucket of over
    `bucket` members is split by further bits (again by the pigeonhole principle) until none is so large,
    so no pair is lost and no bucket is compared whole. With few bits left a bucket can't be larger.
    """
    none = distinct.sparkSession.createDataFrame([], "a long, b long")
    masks = probe_masks(distinct, distance)
    links, keyed = none, distinct
    if masks:
        keyed = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    while masks:
        keyed = keyed.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        large = stage(keyed.groupBy("mask", "value").count().filter(F.col("count") > bucket).drop("count"))
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]
        cold = keyed.join(large, ["mask", "value"], "left_anti") if masks else keyed
        groups = cold.groupBy("mask", "value").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
        links = links.union(groups.select("fps").mapInArrow(lambda batches: near_pairs(batches, distance), "a long, b long"))
        if masks:
            children = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(c) for c in finer(m, distance)]))])
            keyed = keyed.join(large, ["mask", "value"], "left_semi").select("fp", F.explode(children[F.col("mask")]).alias("mask"))
    return links


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    bucket: int = BUCKET,
) -> DataFrame:
    """A row per row of `docs`: id, version (hash of the text), fp (64 bits) and component_id.

    A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's shingles of
    `shingle` words, repeats included; words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a shorter
    text is one shingle, a text without words has fingerprint zero. Fingerprints at most `distance` bits apart
    are linked, and component_id is the smallest id that links reach. Equal fingerprints are one node of
    the search, however many documents have them.

    Null text counts as empty. Null ids are ignored for component_id, which is null only where all ids
    of a component are. Repeated rows stay rows of their own. An empty table gives an empty result.
    """
    rows = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("version"), "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, version long, fp long"
    prints = stage(rows.mapInArrow(lambda batches: fingerprints(batches, shingle), schema))
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    links = connected_components(hamming_links(distinct.select("fp"), distance, bucket))
    nodes = distinct.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select("fp", "component_id")
    return prints.join(nodes, "fp").select("id", "version", "fp", "component_id")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options: int
) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the one of the smallest id.

    Fingerprints a few bits apart are those of texts that differ in little. With `similarity`, what they leave goes through
    `similar.similar_dedup`, too: texts of five-word shingles 0.8 alike differ in some 10 of 64 bits, too many for a pigeonhole search.

    Options and odd cases are those of `simhash_groups`; of rows that repeat the smallest id, one stays
    (if their texts differ, the one of the smallest text hash). Rows of a group without ids collapse to
    one by text hash.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    class_key = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")]
    is_least = F.col("id").eqNullSafe(F.col("component_id"))
    least = groups.filter(is_least).groupBy(*class_key, "version").agg(F.count(F.lit(1)).alias("rows"))
    stays = stage(
        least.groupBy("component_id", "f")
        .agg(F.min(F.struct("version", "rows")).alias("s"))
        .select(F.col("component_id").alias("id"), "s.version", "s.rows")
        .distinct()
    )
    rows = with_row(docs, id=id_col, text=text_col).withColumn("version", F.xxhash64("text"))
    kept = rows.alias("r").join(
        stays.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.version") == F.col("s.version")), "left_semi"
    )
    if not stays.filter("rows > 1").isEmpty():  # repeats of a kept row: the same id and text
        kept = kept.groupBy("id", "version").agg(F.first("row").alias("row"))
    kept = only_row(kept, docs.columns)
    return kept if similarity is None else similar_dedup(stage(kept), id_col, text_col, similarity=similarity)
