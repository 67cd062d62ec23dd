"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints fold into one class first, so that copies are compared once. Classes are laid into tiles by the population counts of their
fingerprints' parts (and, where asked for, by their number of shingles). The sum of the parts' differences is a lower bound of the Hamming distance:
a pair of tiles whose ranges differ beyond the radius is skipped, all other pairs are compared in full by numpy exclusive-or and bit counts. What a
tile pair reports is a spanning forest of its links, never all pairs of a group; components then join the forests.

Where links must be exact, the forests only gather candidates: the shingle sets of each component meet, and pairs within the radius whose exact Jaccard
similarity is high enough are the links. A large component is dealt out in chunks that meet pair by pair.

The comparison is quadratic in the number of classes apart from skipped tile pairs. Tiles grow with the table (TILES at most), so that the driver's
list of tile pairs stays bounded.

Nulls: a null text has no words and fingerprint zero, and is linked like any other. A row without doc_id takes part but gives no component its name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import words
from tidebar.llm.components import connected_components
from tidebar.llm.memory import returning
from tidebar.session import scratch

SEED = 42
#: Classes in a tile: a share of all, within these bounds; beyond TILES tiles they grow, so that the driver's list of pairs stays bounded.
LEAST_TILE, MOST_TILE, TILE_SHARE, TILES = 4096, 65536, 1 / 16, 4096
#: Fingerprints in a block, into which a task divides a tile.
BLOCK = 512
#: Shingles in a chunk of a component whose links are verified.
CHUNK = 4_000_000
#: Texts whose fingerprints are made at once.
ROWS_AT_ONCE = 256
#: Classes (of 16 bytes each) that may be sent to all executors to pick rows by.
SENT = 1_000_000
#: Logarithm by which numbers of shingles are binned.
SIZE_STEP = math.log(1.02)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k consecutive words of the ASCII-lower-cased text, joined by a space; of all words if there are fewer."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(own)
    size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1
    ends = np.cumsum(size) - 1
    n = max(1, len(own) - k + 1)
    begin = (ends - size + 1)[:n].tolist()
    end = (ends[k - 1 :] if len(own) >= k else ends[-1:]).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)]), dtype=">u8").astype(np.uint64)


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return np.uint64(0)
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        set_in = np.unpackbits(octets, axis=1).sum(axis=0)
    else:
        set_in = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return np.packbits(set_in * 2 > len(h)).view(">u8")[0].astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, doc_id: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
    """doc_id, fp (array of `lanes` 64-bit words) and size (distinct shingles). The first word is of XXH64; others are of that hash mixed again.

    sets: fingerprints are over distinct shingles, and their sorted hashes and a digest of them are added.
    """
    extra = [np.uint64(0xA0761D6478BD642F * (2 * j + 1) % 2**64) for j in range(1, lanes)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
            fps, sizes, own, digests = [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                h = shingle_hashes(t or b"", shingle)
                if sets:
                    h = np.unique(h)
                    own.append(h.view(np.int64))
                    digests.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                fps.append(np.array([majority(h), *(majority(words.mix(h ^ c)) for c in extra)], dtype=np.uint64).view(np.int64))
                sizes.append(len(h) if sets else len(np.unique(h)))
            flat = pa.array(np.concatenate(fps) if fps else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * lanes), flat)
            arrays, names = [batch.column(0), lists, pa.array(sizes, pa.int64())], ["doc_id", "fp", "size"]
            if sets:
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                listed = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
                arrays, names = [*arrays, pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), listed], [*names, "digest", "shingles"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, fp array<long>, size long" + (", digest long, shingles array<long>" if sets else "")
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(returning(work), schema)


def _features(lanes: int, radius: int, ratio: float | None) -> list:
    """The columns that tiles are laid out by: counts of parts' set bits; with a ratio, first the binned number of shingles."""
    parts = 4 if lanes == 1 else lanes
    width = 64 * lanes // parts
    mask = (1 << width) - 1
    counts = []
    for p in range(parts):
        word = F.col("fp")[p * width // 64]
        part = word if width == 64 else F.shiftrightunsigned(word, p * width % 64).bitwiseAND(F.lit(mask).cast("long"))
        counts.append(F.bit_count(part).cast("int"))
    return [F.floor(F.log(F.greatest("size", F.lit(1))) / SIZE_STEP).cast("int"), sum(counts, F.lit(0)).cast("int")] if ratio else counts


def _layout(cells: np.ndarray, weight: np.ndarray, tile: int) -> np.ndarray:
    """Halves the cells by their widest feature until a part has at most `tile` classes or is one cell; returns each cell's part."""
    part = np.zeros(len(cells), dtype=np.int64)
    todo, made = [np.arange(len(cells))], 0
    while todo:
        own = todo.pop()
        spread = np.ptp(cells[own], axis=0)
        if weight[own].sum() <= tile or not spread.any():
            part[own] = made
            made += 1
            continue
        by = cells[own][:, int(spread.argmax())]
        order = np.argsort(by, kind="stable")
        run = np.cumsum(weight[own][order])
        cut = np.searchsorted(run, run[-1] / 2)
        at = by[order][min(cut, len(order) - 1)]
        left = by <= at if (by <= at).sum() < len(by) else by < at
        todo += [own[left], own[~left]]
    return part


def _near(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray, radius: int, ratio: float | None) -> np.ndarray:
    """Which of the ranges come within the radius of the first one."""
    gap = np.maximum(0, np.maximum(low - highs, lows - high))
    if ratio:
        return (gap[:, 0] <= math.log(1 / ratio) / SIZE_STEP + 1) & (gap[:, 1] <= radius)
    return gap.sum(axis=1) <= radius


def _pairs(low: np.ndarray, high: np.ndarray, radius: int, ratio: float | None) -> pa.Table:
    """Pairs of tiles that must be compared."""
    others = [i + np.flatnonzero(_near(low[i], high[i], low[i:], high[i:], radius, ratio)) for i in range(len(low))]
    return pa.table({"a": np.repeat(np.arange(len(low)), [len(o) for o in others]), "b": np.concatenate(others)})


def _blocks(fps: np.ndarray, sizes: np.ndarray, ratio: float | None) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """An order of a tile's fingerprints, blocks of it, and the blocks' ranges of counts (finer ones than the tile's)."""
    if ratio:
        counts = np.column_stack([np.floor(np.log(np.maximum(sizes, 1)) / SIZE_STEP), np.bitwise_count(fps).sum(axis=1)]).astype(np.int64)
    else:
        counts = np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8)).reshape(len(fps), -1).astype(np.int64)
    part = _layout(counts, np.ones(len(fps), dtype=np.int64), BLOCK)
    order = np.argsort(part, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]])
    cuts = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    low = np.stack([counts[order[c]].min(axis=0) for c in cuts])
    high = np.stack([counts[order[c]].max(axis=0) for c in cuts])
    return order, cuts, low, high


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _forest(a: np.ndarray, b: np.ndarray, same: bool, sizes: tuple[np.ndarray, np.ndarray], radius: int, ratio: float | None, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles (rows are fingerprints), as places in both laid end to end.

    sets: if given (in the order of those places), links are only pairs whose sets have a Jaccard similarity of at least the ratio.
    """
    parent = list(range(len(a) + (0 if same else len(b))))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, base = [], 0 if same else len(a)
    seen = np.arange(len(parent))  # equal only within a component: what is known to be linked isn't looked at again
    order_a, cuts_a, low_a, high_a = _blocks(a, sizes[0], ratio)
    order_b, cuts_b, low_b, high_b = (order_a, cuts_a, low_a, high_a) if same else _blocks(b, sizes[1], ratio)
    columns_a = [np.ascontiguousarray(a[order_a, k]) for k in range(a.shape[1])]
    columns_b = [np.ascontiguousarray(b[order_b, k]) for k in range(b.shape[1])]
    for i, own in enumerate(cuts_a):
        near = _near(low_a[i], high_a[i], low_b, high_b, radius, ratio)
        near[: i if same else 0] = False
        for j in np.flatnonzero(near).tolist():
            other = cuts_b[j]
            apart = np.bitwise_count(columns_a[0][own][:, None] ^ columns_b[0][other][None, :])
            if len(columns_a) > 1:
                apart = apart.astype(np.uint16)
                for x, y in zip(columns_a[1:], columns_b[1:], strict=True):
                    apart += np.bitwise_count(x[own][:, None] ^ y[other][None, :])
            x, y = np.nonzero(apart <= radius)
            x, y = order_a[own][x], order_b[other][y]
            if ratio and len(x):
                p, q = sizes[0][x], sizes[1][y]
                fit = np.minimum(p, q) >= ratio * np.maximum(p, q)
                x, y = x[fit], y[fit]
            y = y + base
            fresh = seen[x] != seen[y]
            x, y = x[fresh], y[fresh]
            before = len(links)
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                ru, rv = root(u), root(v)
                if ru != rv and (sets is None or jaccard(sets[u], sets[v]) >= ratio):
                    parent[max(ru, rv)] = min(ru, rv)
                    links.append((u, v))
            if len(links) > before:
                touched = np.unique(np.concatenate([x, y]))
                seen[touched] = [root(k) for k in touched.tolist()]
    return links


def link_forest(classes: DataFrame, lanes: int, radius: int, ratio: float | None = None) -> DataFrame:
    """For classes (id, fp, size) with distinct ids: links (a, b) of ids that connect exactly what all links within the radius connect."""
    spark = classes.sparkSession
    columns = _features(lanes, radius, ratio)
    names = [f"f{k}" for k in range(len(columns))]
    placed = classes.select("id", "fp", "size", *(c.alias(n) for c, n in zip(columns, names, strict=True)))
    counted = placed.groupBy(*names).count().toPandas()  # at most a cell for each combination of counts
    if not len(counted):
        return spark.createDataFrame([], "a long, b long")
    cells, weight = counted[names].to_numpy(dtype=np.int64), counted["count"].to_numpy(dtype=np.int64)
    total = int(weight.sum())
    tile = max(LEAST_TILE, min(MOST_TILE, math.ceil(total * TILE_SHARE)), math.ceil(total / TILES))
    part = _layout(cells, weight, tile)
    total = np.bincount(part, weights=weight).astype(np.int64)
    splits = np.maximum(1, -(-total // tile))  # a cell of more than a tile is dealt out by hash
    first = np.cumsum(splits) - splits
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(len(total) + 1))
    low = np.stack([cells[order[bounds[k] : bounds[k + 1]]].min(axis=0) for k in range(len(total))])
    high = np.stack([cells[order[bounds[k] : bounds[k + 1]]].max(axis=0) for k in range(len(total))])
    low, high = np.repeat(low, splits, axis=0), np.repeat(high, splits, axis=0)
    where = counted[names].assign(first=first[part], splits=splits[part])
    # ids are sent only where they aren't the fingerprint itself, and sizes only where they count
    sent = [*(["id"] if lanes > 1 or ratio else []), *(f"w{k}" for k in range(lanes)), *(["size"] if ratio else [])]
    tiles = (
        placed.join(F.broadcast(spark.createDataFrame(where)), names)
        .select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("splits"))).alias("tile"), "id", *(F.col("fp")[k].alias(f"w{k}") for k in range(lanes)), "size")
        .groupBy("tile")
        .agg(*(F.collect_list(c).alias(c) for c in sent))
        .select("tile", F.struct(*sent).alias("rows"))
    )
    folder = scratch(spark, "tiles")
    tiles.write.parquet(folder)
    tiles = spark.read.parquet(folder)
    pairs = spark.createDataFrame(_pairs(low, high, radius, ratio))
    spread = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = pairs.join(tiles.select(F.col("tile").alias("a"), F.col("rows").alias("left")), "a").join(tiles.select(F.col("tile").alias("b"), F.col("rows").alias("right")), "b").repartition(spread, "a", "b")

    def unpack(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = {c: rows[c].values.to_numpy(zero_copy_only=False) for c in sent}
        fps = np.column_stack([own[f"w{k}"].view(np.uint64) for k in range(lanes)])
        return own.get("id", own["w0"]), fps, own.get("size", np.zeros(len(fps), dtype=np.int64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py() == batch.column(1)[k].as_py()
                ia, fa, sa = unpack(batch.column(2)[k])
                ib, fb, sb = (ia, fa, sa) if same else unpack(batch.column(3)[k])
                found = _forest(fa, fb, same, (sa, sb), radius, ratio)
                if found:
                    ids = ia if same else np.concatenate([ia, ib])
                    x = np.array(found, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x[:, 0]]), pa.array(ids[x[:, 1]])], names=["a", "b"])

    return met.select("a", "b", "left", "right").mapInArrow(returning(work), "a long, b long")


def verified_links(members: DataFrame, radius: int, ratio: float) -> DataFrame:
    """For members (id, root, fp, size, shingles) of candidate components: links (a, b) that connect exactly what all pairs of a component connect that
    are within the radius and have a Jaccard similarity of at least the ratio."""
    spark = members.sparkSession
    folder = scratch(spark, "verified")
    members.write.parquet(f"{folder}/members")
    members = spark.read.parquet(f"{folder}/members")  # written, so that a large component's partition can be split in the join
    chunks = members.groupBy("root").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"))
    dealt = members.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("id"), F.greatest("chunks", F.lit(1))).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.greatest("chunks", F.lit(1)) - 1), lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
    spread = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.withColumn("meets", F.explode(meet)).select("root", "meets.i", "meets.j", "chunk", "id", "fp", "size", "shingles")
    met = met.repartition(spread, "root", "i", "j").sortWithinPartitions("root", "i", "j")

    def links(key: tuple[int, int, int], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ids, sizes = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("chunk", "id", "size"))
        fps = np.concatenate([b.column("fp").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in held]).view(np.uint64)
        sets = [s.values.to_numpy(zero_copy_only=False).view(np.uint64) for b in held for s in b.column("shingles")]
        same = key[1] == key[2]
        left, right = np.flatnonzero(chunk == key[1]), np.flatnonzero(chunk == key[2])
        if not len(left) or not len(right):
            return
        order = left if same else np.concatenate([left, right])
        found = _forest(fps[left], fps[right], same, (sizes[left], sizes[right]), radius, ratio, [sets[k] for k in order.tolist()])
        if found:
            x = order[np.array(found, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[:, 0]]), pa.array(ids[x[:, 1]])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("root", "i", "j")])
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if key != now:
                    if held:
                        yield from links(now, held)
                    now, held = key, []
                held.append(batch.slice(a, b - a))
        if held:
            yield from links(now, held)

    return met.mapInArrow(returning(work), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, lanes: int = 1, ratio: float | None = None, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """For every row: doc_id, fp, and component_id, the least doc_id that it reaches over links of at most `radius` differing bits.

    ratio: if given, linked texts' numbers of distinct shingles must also be at least so near (a bound that a Jaccard similarity implies).
    exact: linked texts' sets of shingles must also have a Jaccard similarity of at least the ratio; the radius then only finds candidates.
    """
    if exact and not ratio:
        raise ValueError("exact links need a ratio")
    spark = docs.sparkSession
    folder = scratch(spark, "simhash")
    keys = [*(["fp", "size"] if ratio else ["fp"]), *(["digest"] if exact else [])]
    fingerprints(docs, shingle, lanes, doc_id, text, sets=exact).withColumn("rid", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    folded = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"))
    # one word is its own id; several words get the id of their hash, 128 bits of which would be needed only beyond billions of classes
    named = folded.select(*keys, "least", (F.col("fp")[0] if lanes == 1 and not ratio else F.xxhash64(*keys)).alias("id"))
    named.write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")
    sized = classes if ratio else classes.withColumn("size", F.lit(0).cast("long"))
    links = link_forest(sized.select("id", "fp", "size"), lanes, radius, ratio)
    links.write.parquet(f"{folder}/links")
    roots = connected_components(spark.read.parquet(f"{folder}/links"))
    if exact:
        # one row of each class in a component; sets are read of these rows only
        first = rows.select("rid", F.xxhash64(*keys).alias("id")).join(roots.select(F.col("node").alias("id"), "root"), "id").groupBy("id", "root").agg(F.min("rid").alias("rid"))
        first.write.parquet(f"{folder}/first")
        first = spark.read.parquet(f"{folder}/first")
        few = first.limit(SENT + 1).count() <= SENT
        verified_links(rows.select("rid", "fp", "size", "shingles").join(F.broadcast(first) if few else first, "rid").drop("rid"), radius, ratio).write.parquet(f"{folder}/verified")
        roots = connected_components(spark.read.parquet(f"{folder}/verified"))
    placed = classes.join(roots, classes["id"] == roots["node"], "left").select(*keys, "least", F.coalesce("root", "id").alias("root"))
    placed.groupBy("root").agg(F.min("least").alias("component_id")).write.parquet(f"{folder}/names")
    names = spark.read.parquet(f"{folder}/names")  # written, so that a large component's partition can be split in the join
    placed.join(names, "root").select(*keys, "component_id").write.parquet(f"{folder}/components")
    return rows.join(spark.read.parquet(f"{folder}/components"), keys).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):  # noqa: ANN001, ANN201
    """A one-word fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp[0]), 16, "0"))
