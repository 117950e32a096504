"""Near-duplicates by SimHash and a generalised pigeonhole search (operator 2).

Fingerprints within ``TAU`` bits are found by parts of the 64 bits: if part i
has the threshold t_i and the sum of (t_i + 1) is TAU + 1, two such fingerprints
agree up to t_i bits in at least one part. Correlated bits go to one part; a
dynamic programme allots the thresholds (-1: the part is not probed) by the
candidates that each would bring, estimated from all fingerprints. Rows meet at
their probed values and are verified on all 64 bits.

Only different fingerprints are compared. A group at one value sends the edges
of a spanning forest, not its pairs. A group over ``GROUP`` fingerprints is split
again by parts of the bits that its members may still differ in; after three
splits at most 2**19 different fingerprints can be left in one.

Defined results: null and empty texts have the fingerprint zero and link like
any other; ties and repeated rows share fingerprint and component; a null
doc_id counts as the smallest in component_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.components import components
from ticketloom.session import drop_table, materialise

TAU = 2
SHINGLE = 3
#: What the pipeline's stage takes: a link needs that share of common shingles of so many words. Fingerprints of 5-word
#: shingles of such texts differ in 10 bits, those of their different words in 3 or 4: within 3 bits these find half of the
#: pairs (0.52 of those of the 10,000-document table), within 6 bits 0.88; 5 bits take 6 parts.
STAGE_SHINGLE, STAGE_LIKENESS, STAGE_TAU = 5, 0.8, 5
#: Shingle hashes by which the share is taken: exact up to so many different shingles, beyond with a deviation of 0.02.
SKETCH = 512
#: Bins of the short sketch that rows of the stage carry, and the estimated shares by which links are tried, likeliest first.
#: Its deviation at 0.8 is 0.025, so that the last is four deviations below what a link needs.
BINS, TIERS = 256, (0.85, 0.8, 0.75, 0.7)
GROUP = 8192
#: Probes for each fingerprint that are sent at once where rows carry sketches.
PASS_PROBES = 6
NULL_ID = -(1 << 63)


def shingle_hashes(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 with seed 42 of the word shingles of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def word_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 with seed 42 of the different words of a text, A-Z lower-cased."""
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in set((text or b"").lower().split())], np.uint64)


def text_key(text: bytes | None) -> int:
    """Tells texts with the same doc_id apart; the same as xxhash64 of the text in Spark."""
    return signed(xxhash.xxh64_intdigest(text or b"", 42))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")
    return value - (1 << 64) if value >> 63 else value


def bins(hashes: np.ndarray) -> bytes:
    """One byte of the smallest hash of each of ``BINS`` ranges of hashes; 0 for a range without one."""
    least = np.unique(hashes)
    found = np.zeros(BINS, np.uint8)
    if len(least):
        place, first = np.unique((least >> np.uint64(56)).astype(np.int64), return_index=True)
        found[place] = least[first] % np.uint64(255) + np.uint64(1)
    return found.tobytes()


def likely(brief: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """The share of common shingles that the short sketches of rows ``i`` and ``j`` suggest; 1 where both are empty."""
    shares = np.ones(len(i))
    for a in range(0, len(i), chunk):
        x, y = brief[i[a : a + chunk]], brief[j[a : a + chunk]]
        either = ((x | y) > 0).sum(axis=1)
        same = ((x == y) & (x > 0)).sum(axis=1)
        shares[a : a + chunk] = np.where(either > 0, same / np.maximum(either, 1), 1.0)
    return shares


def fingerprints(docs: DataFrame, sketched: int | None = None) -> DataFrame:
    """doc_id, fp and text_key of each row; with ``sketched`` fp is that of the different words, and brief the short sketch of shingles of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [fingerprint(word_hashes(t) if sketched else shingle_hashes(t)) for t in texts]
            out = {"doc_id": batch.column(0), "fp": pa.array(found, pa.int64()), "text_key": pa.array([text_key(t) for t in texts], pa.int64())}
            if sketched:
                out["brief"] = pa.array([bins(shingle_hashes(t, sketched)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, fp long, text_key long" + (", brief binary" if sketched else "")
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both of each pair of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            x = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            bits = (x[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(x)
        cells = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(cells)], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows, whatever the input
    cells = np.zeros(4097, np.int64)
    for row in rows:
        cells[row["cell"]] = row["n"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, bits: list[int], k: int) -> list[list[int]]:
    """``k`` parts of near-equal size; each starts with a free bit and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, parts = list(bits), []
    for i in range(k):
        size = len(bits) // k + (i < len(bits) % k)
        part = [max(free, key=lambda b: (corr[b][[x for x in free if x != b]].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: (corr[b][part].mean(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def allot(n: int, p: np.ndarray, parts: list[list[int]], tau: int = TAU) -> tuple[float, list[int]]:
    """The cheapest thresholds of the parts, and their cost: rows probed and candidates expected."""
    costs = []
    for part in parts:
        differ = np.array([1.0])
        for b in part:  # how many bits of the part differ between two fingerprints
            q = 2 * p[b] * (1 - p[b])
            differ = np.convolve(differ, [1 - q, q])
        probes = [sum(math.comb(len(part), e) for e in range(t + 1)) for t in range(tau + 1)]
        costs.append([0.0, *(n * probes[t] + n * n / 2 * differ[: t + 1].sum() for t in range(min(tau, len(part)) + 1))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for spent, price in enumerate(options):  # spent = threshold + 1
                if used + spent <= tau + 1:
                    entry = (cost + price, [*chosen, spent - 1])
                    if used + spent not in nxt or entry < nxt[used + spent]:
                        nxt[used + spent] = entry
        best = nxt
    return best.get(tau + 1, (math.inf, []))


def plan(n: int, both: np.ndarray, bits: list[int] | None = None, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Parts to probe with their thresholds: the cheapest over the numbers of parts tried."""
    bits = list(range(64)) if bits is None else bits
    p = np.diag(both) / max(n, 1)
    tried = []
    for k in range(1, tau + 3):
        parts = group_bits(n, both, bits, k)
        cost, thresholds = allot(n, p, parts, tau)
        tried.append((cost, k, [(x, t) for x, t in zip(parts, thresholds, strict=False) if t >= 0]))
    return min(tried)[2]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, tau: int, block: int = 512) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints (uint64, different) within ``tau`` bits of each other."""
    n = len(fps)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    edges = []
    for a in range(0, n, block):
        close = np.bitwise_count(fps[a : a + block, None] ^ fps[None, : a + block]) <= tau
        i, j = np.nonzero(close)
        i += a
        i, j = i[j < i], j[j < i]
        label = np.array([top(x) for x in np.unique(j)], np.int64)[np.searchsorted(np.unique(j), j)] if len(j) else j
        _, one = np.unique(i * np.int64(n) + label, return_index=True)  # one edge to each tree
        for x, y in zip(i[one].tolist(), j[one].tolist(), strict=True):
            rx, ry = top(x), top(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                edges.append((x, y))
    return edges


def likely_forest(fps: np.ndarray, brief: np.ndarray, tau: int, block: int = 512) -> list[tuple[int, int]]:
    """As forest, of pairs whose short sketches suggest a share of one of ``TIERS``, the likeliest first."""
    label, edges = np.arange(len(fps)), []
    members: dict[int, list[int]] = {}
    left: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # pairs of each block that are still apart, in small groups

    def join(i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = int(label[x]), int(label[y])
            if p != q:
                mine, other = members.pop(p, [p]), members.pop(q, [q])
                if len(mine) < len(other):
                    p, mine, other = q, other, mine
                label[other] = p
                members[p] = mine + other
                edges.append((x, y))

    for least in TIERS:
        for a in range(0, len(fps), block):
            if a in left:
                i, j = left[a]
            else:
                i, j = np.nonzero(np.bitwise_count(fps[a : a + block, None] ^ fps[None, : a + block]) <= tau)
                i, j = i + a, j
                i, j = i[j < i], j[j < i]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if len(fps) <= 4 * block:
                left[a] = i, j
            if not len(i):
                continue
            _, one = np.unique(i * np.int64(len(fps)) + label[j], return_index=True)  # one of each tree first: most are alike
            good = likely(brief, i[one], j[one]) >= least
            join(i[one][good], j[one][good])
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            good = likely(brief, i, j) >= least
            join(i[good], j[good])
    return edges


def probe_forest(fps: np.ndarray, free: list[int], tau: int, brief: np.ndarray | None = None) -> list[tuple[int, int]]:
    """As forest (with ``brief``: likely_forest), for many fingerprints that differ in few bits: each looks up those within ``tau`` flips."""
    order = np.argsort(fps)
    known, edges = fps[order], []
    label = np.arange(len(fps))
    for least in (0.0,) if brief is None else TIERS:
        for k in range(1, tau + 1):
            for flips in combinations(free, k):
                want = known ^ np.uint64(mask_of(list(flips)))
                at = np.minimum(np.searchsorted(known, want), len(known) - 1)
                hit = np.flatnonzero((known[at] == want) & (at > np.arange(len(known))))
                new = hit[label[hit] != label[at[hit]]]
                if brief is not None:
                    new = new[likely(brief, order[new], order[at[new]]) >= least]
                for x in new.tolist():
                    y = int(at[x])
                    a, b = label[x], label[y]
                    if a != b:
                        label[label == max(a, b)] = min(a, b)
                        edges.append((int(order[x]), int(order[y])))
    return edges


def link(reps: DataFrame, tau: int = TAU, group: int = GROUP) -> DataFrame:
    """Links (u, v: smallest doc_ids of two fingerprints) that connect all fingerprints within ``tau`` bits.

    ``reps`` has one row for each fingerprint: fp and rep. With a column brief (short sketches) the links also need a
    suggested share of the last of ``TIERS``, and the likeliest are taken first: then what is dropped when links are
    verified by a higher share does not part fingerprints that others of that share connect.
    """
    n, both = bit_counts(reps)
    extra = ["brief"] if "brief" in reps.columns else []
    levels: list[DataFrame] = []

    def spread(source: DataFrame, key: str | None, done: str | None, parts: list[tuple[list[int], int]]) -> DataFrame:
        found = []
        for number, (part, t) in enumerate(parts):
            flips = [signed(mask_of(list(f))) for k in range(t + 1) for f in combinations(part, k)]
            mask = signed(mask_of(part))
            value = F.col("fp").bitwiseAND(F.lit(mask))
            step = source.withColumn("flip", F.explode(F.array(*[F.lit(f) for f in flips]))) if len(flips) > 1 else source.withColumn("flip", F.lit(0).cast("long"))
            value = value.bitwiseXOR(F.col("flip"))
            here = F.xxhash64(F.lit(number), value) if key is None else F.xxhash64(F.col(key), F.lit(number), value)
            fixed = F.lit(mask if t == 0 else 0).cast("long") if done is None else F.col(done).bitwiseOR(F.lit(mask if t == 0 else 0).cast("long"))
            found.append(step.select(here.alias("key"), fixed.alias("fixed"), "fp", "rep", *extra))
        return reduce(DataFrame.unionByName, found)

    def work(limit: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def flush(table: pa.Table) -> pa.RecordBatch:
                key = table["key"].to_numpy()
                fp = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
                rep, fixed = table["rep"].to_numpy(), table["fixed"].to_numpy()
                brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint8).reshape(-1, BINS) if extra else None
                edges = np.flatnonzero(np.diff(key)) + 1
                u, v = [], []
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                    if b - a < 2:
                        continue
                    if b - a == 2 and brief is None:
                        pairs = [(0, 1)] if int(fp[a] ^ fp[a + 1]).bit_count() <= tau else []
                        mine = rep[a:b]
                    else:
                        mine_fp, one = np.unique(fp[a:b], return_index=True)
                        mine = rep[a:b][one]
                        same = int(fixed[a])
                        short = None if brief is None else brief[a:b][one]
                        if len(mine_fp) <= (limit or len(mine_fp)) and (limit or len(mine_fp) <= GROUP):
                            pairs = forest(mine_fp, tau) if short is None else likely_forest(mine_fp, short, tau)
                        else:
                            pairs = probe_forest(mine_fp, [b for b in range(64) if not same >> b & 1], tau, short)
                    for x, y in pairs:
                        u.append(int(mine[x]))
                        v.append(int(mine[y]))
                return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

            for batch in batches:  # rows are sorted by key; the last key of a batch may go on
                if not batch.num_rows:
                    continue
                held.append(batch)
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                if key[0] == key[-1]:
                    continue
                cut = int(np.searchsorted(key, key[-1]))
                yield flush(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
            if held:
                yield flush(pa.Table.from_batches(held))

        return run

    def split(heavy: DataFrame) -> DataFrame | None:
        used = [r["fixed"] for r in heavy.select("fixed").distinct().collect()]  # one for each choice of probed parts, whatever the rows
        # within a group the fixed bits agree: only the others are split again, for each set of fixed bits
        found = []
        for fixed in used:
            bits = [b for b in range(64) if not fixed >> b & 1]
            parts = [(part, 0) for part in group_bits(n, both, bits, tau + 1)]
            found.append(spread(heavy.filter(F.col("fixed") == fixed), "key", "fixed", parts))
        return reduce(DataFrame.unionByName, found) if found else None

    def linked(light: DataFrame, limit: int | None) -> DataFrame:
        ordered = light.repartition("key").sortWithinPartitions("key").select("key", "fixed", "fp", "rep", *extra)
        return ordered.mapInArrow(work(limit), "u long, v long")

    if extra:
        # rows with sketches are wide: they are sent in passes, and only links (and rows of heavy groups) are written
        for rows in _passes(spread, reps, plan(n, both, tau=tau)):
            above = None
            for level in range(4):
                heavy_keys = materialise(rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > group).select("key"), "heavy-keys")
                some = level < 3 and not heavy_keys.isEmpty()
                light = rows.join(F.broadcast(heavy_keys), "key", "left_anti") if some else rows  # at most one key for each ``group`` rows
                levels.append(materialise(linked(light, None if level == 3 else group), "level"))
                heavy = materialise(rows.join(F.broadcast(heavy_keys), "key", "left_semi").select("key", "fixed", "fp", "rep", *extra), "heavy") if some else None
                if above is not None:
                    drop_table(above)
                drop_table(heavy_keys)
                if heavy is None:
                    break
                above, rows = heavy, split(heavy)
        return reduce(DataFrame.unionByName, levels)
    rows = spread(reps, None, None, plan(n, both, tau=tau))
    for level in range(4):
        rows = materialise(rows, "probes")
        sizes = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        grouped = rows.join(sizes, "key")
        levels.append(linked(grouped if level == 3 else grouped.filter(F.col("size") <= group), None if level == 3 else group))
        if level == 3:
            break
        heavy = materialise(grouped.filter(F.col("size") > group).select("key", "fixed", "fp", "rep", *extra), "heavy")
        rows = split(heavy)
        if rows is None:
            break
    return reduce(DataFrame.unionByName, levels)


def _passes(spread: Callable[..., DataFrame], reps: DataFrame, parts: list[tuple[list[int], int]]) -> Iterator[DataFrame]:
    """The probes of all parts in passes of about ``PASS_PROBES`` rows for each row of ``reps``; a value's rows are all in one pass."""
    held: list[tuple[list[int], int]] = []
    most = PASS_PROBES
    for part, t in sorted(parts, key=lambda x: x[1]):
        probes = sum(math.comb(len(part), k) for k in range(t + 1))
        if probes > most:
            slices = math.ceil(probes / most)
            whole = spread(reps, None, None, [(part, t)])
            for i in range(slices):
                yield whole.filter(F.pmod("key", F.lit(slices)) == i)
            continue
        if sum(math.comb(len(p), k) for p, u in held for k in range(u + 1)) + probes > most:
            yield spread(reps, None, None, held)
            held = []
        held.append((part, t))
    if held:
        yield spread(reps, None, None, held)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with loom_id (doc_id, null as the smallest) and loom_key (text_key)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("loom_id"), F.xxhash64(text).alias("loom_key"))


def sketches(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """rep and the ``SKETCH`` smallest different shingle hashes of its text, for each row (rep, loom_id, loom_key) of ``chosen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [np.unique(shingle_hashes(t, width))[:SKETCH].tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.binary())], names=["rep", "least"])

    texts = keyed(docs).join(chosen, ["loom_id", "loom_key"]).selectExpr("rep", "coalesce(cast(text as string), '') text")
    return texts.mapInArrow(run, "rep long, least binary").groupBy("rep").agg(F.min("least").alias("least"))


def likeness(a: bytes, b: bytes) -> float:
    """Share of common shingles, of the smallest of both: exact where both have at most ``SKETCH``."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        both = both[:SKETCH]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(x, y)).mean())


def verified(links: DataFrame, docs: DataFrame, reps: DataFrame, width: int, least: float) -> DataFrame:
    """The links whose texts have at least that share of their shingles in common, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(a, b) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    vertices = links.select(F.explode(F.array("u", "v")).alias("rep")).distinct()
    chosen = reps.join(vertices, "rep", "left_semi").select("rep", F.col("first.id").alias("loom_id"), F.col("first.text_key").alias("loom_key"))
    known = materialise(sketches(docs, chosen, width), "sketches")
    a, b = known.select(F.col("rep").alias("u"), F.col("least").alias("x")), known.select(F.col("rep").alias("v"), F.col("least").alias("y"))
    found = materialise(links.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "verified")
    drop_table(known)
    return found


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and text_key of each row."""
    fps = materialise(fingerprints(docs), "fingerprints")
    reps = materialise(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("rep")), "representatives")
    linked = components(link(reps, tau))
    known = reps.join(linked, reps["rep"] == linked["vertex"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"), "text_key")


def keep_one(docs: DataFrame, tau: int = STAGE_TAU, width: int = STAGE_SHINGLE, least: float = STAGE_LIKENESS) -> DataFrame:
    """One row of each group of texts that share ``least`` of their shingles: that with the smallest doc_id (null first), then text_key.

    Candidates have fingerprints of their different words within ``tau`` bits; their links are verified by shingles. Texts
    with the same fingerprint are one. Groups are numbered by fingerprint, so that different texts that share a doc_id,
    null or not, stay apart. Of rows equal in doc_id and text one stays.
    """
    fps = materialise(fingerprints(docs, width), "fingerprints")
    place = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text_key")
    reps = materialise(fps.groupBy("fp").agg(F.min(F.struct(place.alias("first"), "brief")).alias("least")).selectExpr("fp", "fp rep", "least.first first", "least.brief brief"), "representatives")
    levels = link(reps.select("fp", "rep", "brief"), tau)
    links = materialise(levels.distinct(), "links")
    drop_table(levels)
    checked = verified(links, docs, reps, width, least)
    linked = components(checked)
    group = F.coalesce("component", "rep").alias("group")
    kept = reps.join(linked, reps["rep"] == linked["vertex"], "left").select(group, "first").groupBy("group").agg(F.min("first").alias("first"))
    twins = fps.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("loom_id"), F.col("text_key").alias("loom_key")).agg((F.count("*") > 1).alias("loom_twin"))
    kept = materialise(kept.select(F.col("first.id").alias("loom_id"), F.col("first.text_key").alias("loom_key")).join(twins, ["loom_id", "loom_key"]), "kept")
    for table in (fps, reps, links, checked, linked):  # what is returned reads documents and ``kept`` alone
        drop_table(table)
    columns = docs.columns
    chosen = keyed(docs).join(kept, ["loom_id", "loom_key"])
    once = chosen.filter("NOT loom_twin").select(*columns)
    return once.unionByName(chosen.filter("loom_twin").dropDuplicates(["loom_id", "loom_key"]).select(*columns))
