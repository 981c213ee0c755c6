"""Near-duplicate documents by MinHash and an LSH forest.

Signatures of 64 minima are sorted in 16 orders, each starting at another value. Documents that
share the first values of an order form a region of its sorted list, as under a node of
a prefix tree. Candidates are a document's neighbours in the list, those with the longest common
prefixes, and the region's centre, the document nearest to the most common values. A large
region is split at the depth at which its prefixes part, and each part has a centre again. The list is
range-partitioned by whole signatures and id, so that even one region of a third of all rows
spreads over tasks. Regions that are cut meet again by their ends, and each of them has a centre among the rows of all its
tasks, with which every row of it is a candidate. Candidates grow in
proportion to documents and are never capped by score.

Links are confirmed on full shingle sets: at first each document's best candidate; then, of the
others, all that would join two groups. Documents of equal sets are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.llm._bloom import partnered
from emberleaf.llm._graph import components
from emberleaf.llm._skew import copied, dealt, hot, spread
from emberleaf.llm._spark import NULL_ID, bounded, dropped, numbered, stored, trimmed
from emberleaf.llm._text import cut, mix, pair, scan, shingles

VALUES, ORDERS, DEPTH = 64, 16, 4
#: Regions above this size are split further. Neighbours taken from the sorted list on each side.
REGION, NEAR = 24, 3
#: Equal values of 64 below which no pair of Jaccard 0.8 falls, but for one in 10^8.
AGREE = 32

#: Crowded rows of one task that looks for candidates.
TASK_ROWS = 20_000
#: Rows of cut regions that a task holds at once.
HELD_ROWS = 50_000

_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, texts by VALUES; of an empty set the greatest value."""
    n = len(off) - 1
    out = np.full((n, VALUES), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        start = off[some]
        for k in range(VALUES):
            x = h * _SEEDS[k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            out[some, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), start)
    out *= np.uint32(0x9E3779B1)  # minima of large sets differ in their low bits alone
    return (out >> np.uint32(16)).astype(np.uint16)


def _describe(words: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in cut(b.column(0)):
                h, off = shingles(scan(b.column(0).slice(lo, hi - lo), lower=True), words)
                n = np.diff(off)
                sums = np.zeros((2, hi - lo), np.uint64)
                some = np.flatnonzero(n)
                for i, salt in enumerate((1, 2)):
                    if len(some):
                        sums[i, some] = np.add.reduceat(mix(h + np.uint64(salt)), off[some])
                sig = signatures(h, off).tobytes()
                yield pa.RecordBatch.from_arrays([*(b.column(i + 1).slice(lo, hi - lo) for i in range(rest)), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([sig[i : i + 2 * VALUES] for i in range(0, len(sig), 2 * VALUES)], pa.binary())], names=["ord", "th", "n", "s1", "s2", "sig"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each order a hash of the first values, its last bits the order's number."""
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, VALUES).astype(np.uint64)
        for t in range(ORDERS):
            key = np.zeros(len(sig), np.uint64)
            for k in range(DEPTH):
                key = pair(key, sig[:, t * (VALUES // ORDERS) + k])
            key = key & ~np.uint64(ORDERS - 1) | np.uint64(t)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], names=["prefix", "rep"])


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures from the value at which each order starts, as bytes that sort like the values."""
    for b in batches:
        if not b.num_rows:
            continue
        tree = b.column(0).to_numpy()
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, VALUES)
        at = (np.arange(VALUES) + tree[:, None] * (VALUES // ORDERS)) % VALUES
        raw = np.take_along_axis(sig, at, 1).astype(">u2").tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + 2 * VALUES] for i in range(0, len(raw), 2 * VALUES)], pa.binary()), *b.columns[2:]], names=["tree", "sig", *b.schema.names[2:]])


def _pairs(sig: np.ndarray, tree: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Candidate rows (first, second) of a sorted list and the centres of its outermost regions."""
    size = len(sig)
    same = (sig[1:] == sig[:-1]) & (tree[1:] == tree[:-1])[:, None]
    depth = np.where(same.all(1), VALUES, same.argmin(1))  # values that each row shares with the one before
    first, second = [], []
    for k in range(1, NEAR + 1):
        run = depth.copy()
        for j in range(1, k):
            run = np.minimum(run[: size - 1 - j], depth[j:])[: size - k]
        at = np.flatnonzero(run[: max(0, size - k)] >= DEPTH)
        first.append(at)
        second.append(at + k)
    centres: dict[int, int] = {}

    def visit(lo: int, hi: int, least: int) -> int:
        rows = sig[lo:hi]
        if hi - lo > 512:
            rows = np.sort(rows, axis=0)
            run = np.array([np.diff(np.flatnonzero(np.diff(c, prepend=c[:1] + np.uint16(1), append=c[-1:] + np.uint16(1)))).argmax() for c in rows.T])
            heads = [np.flatnonzero(np.diff(c, prepend=c[:1] + np.uint16(1))) for c in rows.T]
            common = np.array([c[h[r]] for c, h, r in zip(rows.T, heads, run, strict=True)])
        else:
            common = np.array([np.bincount(np.unique(c, return_inverse=True)[1]).argmax() for c in rows.T])
            common = np.array([np.unique(c)[i] for c, i in zip(rows.T, common, strict=True)])
        centre = lo + int((sig[lo:hi] == common).sum(1).argmax())
        others = np.delete(np.arange(lo, hi), centre - lo)
        first.append(np.full(len(others), centre))
        second.append(others)
        return centre

    starts = np.concatenate([[0], np.flatnonzero(depth < DEPTH) + 1, [size]])
    work = [(int(a), int(b), DEPTH) for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1]
    while work:
        lo, hi, least = work.pop()
        centre = visit(lo, hi, least)
        if lo == 0 or hi == size:
            centres.setdefault(lo if lo == 0 else hi, centre)
        if hi - lo > REGION:
            inner = depth[lo : hi - 1]
            split = int(inner.min())
            if split < VALUES:
                marks = np.concatenate([[lo], np.flatnonzero(inner == split) + lo + 1, [hi]])
                work += [(int(a), int(b), split + 1) for a, b in zip(marks[:-1], marks[1:], strict=True) if b - a > 3]
    return np.concatenate(first), np.concatenate(second), list(centres.values())


def _candidates(ends: bool):
    """Candidate pairs of a partition of the sorted list and, with ``ends``, the rows at which regions may go on in the next one, ``agree`` being the number of their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(_runs(batches)):
            tree = table["tree"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), ">u2").reshape(-1, VALUES).astype(np.uint16)
            n, ids, th = (table[c].to_numpy() for c in ("n", "rep", "th"))
            if len(n) > 1:
                a, b, centres = _pairs(sig, tree, n, ids)
            else:
                a = b = np.zeros(0, np.int64)
                centres = []
            agree = np.concatenate([(sig[a[i : i + 65536]] == sig[b[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)]) if len(a) else a
            use = (agree >= AGREE) & (ids[a] != ids[b]) & (100 * np.minimum(n[a], n[b]) >= 80 * np.maximum(n[a], n[b]))
            a, b, agree = a[use], b[use], agree[use]
            swap = ids[a] > ids[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            none = pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(th[a]), pa.array(ids[b]), pa.array(th[b]), pa.array(agree, pa.int64()), none, pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())], names=NAMES)
            if ends:
                at = np.unique(np.concatenate([np.arange(min(NEAR, len(n))), np.arange(max(0, len(n) - NEAR), len(n)), np.array(centres, np.int64)]).astype(np.int64))
                none = pa.nulls(len(at), pa.int64())
                list_ = pa.array(np.full(len(at), TaskContext.get().partitionId() << 20 | k))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(th[at]), none, none, list_, pa.array(tree[at], pa.int32()), table["sig"].take(pa.array(at)).combine_chunks(), pa.array(n[at])], names=NAMES)

    return run


NAMES = ["a", "ta", "b", "tb", "agree", "tree", "sig", "n"]
PAIRS = "a long, ta long, b long, tb long, agree long, tree int, sig binary, n long"


def _runs(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.Table]:
    """The partition in tables of at most about ``most`` rows, each beginning with the last rows of the one before."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= most:
            table = pa.Table.from_batches(held)
            yield table
            held = table.slice(len(table) - NEAR - 1).combine_chunks().to_batches()
            size = 0
    if size:
        yield pa.Table.from_batches(held)


def _keys(sig: np.ndarray, tree: np.ndarray, most: int = VALUES) -> Iterator[tuple[int, np.ndarray]]:
    """Each depth with the keys of the regions in which turned signatures are at that depth."""
    key = mix(tree.astype(np.uint64) + np.uint64(1))
    for k in range(most):
        key = pair(key, sig[:, k].astype(np.uint64))
        yield k + 1, key


def _cut_regions(ends: DataFrame) -> list[list[tuple[int, int]]]:
    """For each cut of the sorted list the regions (depth, key) on both of its sides, from the widest."""
    edge = ends.groupBy("agree").agg(F.min(F.struct("tree", "sig")).alias("lo"), F.max(F.struct("tree", "sig")).alias("hi")).orderBy("lo", "hi").toArrow().to_pylist()
    out = []
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        a, b = (np.frombuffer(r["sig"], ">u2").astype(np.uint16) for r in (x["hi"], y["lo"]))
        same = VALUES if (a == b).all() else int((a != b).argmax())
        if x["hi"]["tree"] == y["lo"]["tree"] and same >= DEPTH:
            out.append([(d, int(k[0])) for d, k in _keys(a[None], np.array([y["lo"]["tree"]]), same) if d >= DEPTH])
    return out


def _of_regions(shared, emit, schema: pa.Schema):
    """Rows by ``emit(region, sig, rows)`` for the rows of each region of ``shared``, a broadcast map from depth to sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, size = shared.value, [], 0

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), ">u2").reshape(-1, VALUES).astype(np.uint16)
            for depth, key in _keys(sig, rows["tree"].to_numpy(), max(wanted)):
                if depth in wanted:
                    want = wanted[depth]
                    own = np.flatnonzero(want[np.minimum(np.searchsorted(want, key), len(want) - 1)] == key)
                    own = own[np.argsort(key[own], kind="stable")]
                    for part in np.split(own, np.flatnonzero(np.diff(key[own])) + 1):
                        if len(part):
                            region = int(key[part[0]])
                            yield pa.RecordBatch.from_pydict(emit(region, sig[part], rows.take(pa.array(part))), schema=schema)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= HELD_ROWS:
                yield from done()
                held, size = [], 0
        if size:
            yield from done()

    return run


def _signed(region: int) -> int:
    return int(np.uint64(region).view(np.int64))


def _size(region: int, sig: np.ndarray, rows: pa.Table) -> dict:
    return {"region": [_signed(region)], "c": [len(sig)]}


def _common(region: int, sig: np.ndarray, rows: pa.Table) -> dict:
    """The most common value at each place and how many rows have it."""
    value, count = np.zeros(VALUES, np.uint16), np.zeros(VALUES, np.int64)
    for i, c in enumerate(sig.T):
        v, n = np.unique(c, return_counts=True)
        value[i], count[i] = v[n.argmax()], n.max()
    return {"region": [_signed(region)], "value": [value.tobytes()], "c": [count.tobytes()]}


def _voted(key, table):
    """Of one region the value at each place that most rows of all tasks have."""
    value = np.frombuffer(b"".join(table["value"].to_pylist()), np.uint16).reshape(-1, VALUES)
    count = np.frombuffer(b"".join(table["c"].to_pylist()), np.int64).reshape(-1, VALUES)
    most = []
    for v, c in zip(value.T, count.T, strict=True):
        own, at = np.unique(v, return_inverse=True)
        most.append(own[np.bincount(at, c).argmax()])
    return pa.table({"region": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([np.array(most, np.uint16).tobytes()], pa.binary())})


def _nearest(common):
    """The row that agrees most with the region's common values."""

    def emit(region: int, sig: np.ndarray, rows: pa.Table) -> dict:
        agree = (sig == common.value[region]).sum(1)
        best = np.flatnonzero(agree == agree.max())
        r = rows.take(pa.array(best[[rows["rep"].to_numpy()[best].argmin()]])).to_pylist()[0]
        return {"region": [_signed(region)], "agree": [int(agree.max())], **{c: [r[c]] for c in ("rep", "th", "n", "sig")}}

    return emit


def _to_centre(centres):
    """Candidate pairs of each row with its region's centre."""

    def emit(region: int, sig: np.ndarray, rows: pa.Table) -> dict:
        rep, th, n, own = centres.value[region]
        ids, hashes, size = (rows[c].to_numpy() for c in ("rep", "th", "n"))
        agree = (sig == own).sum(1)
        use = (agree >= AGREE) & (ids != rep) & (100 * np.minimum(size, n) >= 80 * np.maximum(size, n))
        ids, hashes, agree = ids[use], hashes[use], agree[use]
        low = ids < rep
        return {"a": np.where(low, ids, rep), "ta": np.where(low, hashes, th), "b": np.where(low, rep, ids), "tb": np.where(low, th, hashes), "agree": agree.astype(np.int64)}

    return emit


def _centred(rows: DataFrame, ends: DataFrame) -> DataFrame | None:
    """Candidate pairs of the centres of all regions that tasks cut with every row of them; None if no region is cut."""
    ship = rows.sparkSession.sparkContext.broadcast
    longs = lambda *names: pa.schema([(c, pa.int64()) for c in names])
    cuts = _cut_regions(ends)
    if not cuts:
        return None

    def wanted(regions: set[tuple[int, int]]):
        return ship({d: np.array(sorted(k for e, k in regions if e == d), np.uint64) for d in {d for d, _ in regions}})

    def per(regions, emit, schema: pa.Schema, kinds: str) -> DataFrame:
        return rows.mapInArrow(trimmed(_of_regions(regions, emit, schema)), kinds)

    every = {r for c in cuts for r in c}
    got = per(wanted(every), _size, longs("region", "c"), "region long, c long").groupBy("region").agg(F.sum("c").alias("c")).collect()
    size = {r["region"]: r["c"] for r in got}
    # regions of one cut that hold the same rows are one
    kept = {(d, k) for c in cuts for i, (d, k) in enumerate(c) if not i or size.get(_signed(k)) != size.get(_signed(c[i - 1][1]))}
    regions = wanted(kept)
    bytes_ = [pa.field(c, pa.binary()) for c in ("value", "c")]
    seen = per(regions, _common, longs("region").append(bytes_[0]).append(bytes_[1]), "region long, value binary, c binary")
    most = seen.groupBy("region").applyInArrow(_voted, "region long, value binary").collect()
    common = {int(np.int64(r["region"]).view(np.uint64)): np.frombuffer(r["value"], np.uint16) for r in most}
    nearest = per(regions, _nearest(ship(common)), longs("region", "agree", "rep", "th", "n").append(pa.field("sig", pa.binary())), "region long, agree long, rep long, th long, n long, sig binary")
    best = nearest.groupBy("region").agg(F.max(F.struct("agree", (-F.col("rep")).alias("o"), "rep", "th", "n", "sig")).alias("r")).select("region", "r.rep", "r.th", "r.n", "r.sig").collect()
    centres = {int(np.int64(r["region"]).view(np.uint64)): (r["rep"], r["th"], r["n"], np.frombuffer(r["sig"], ">u2").astype(np.uint16)) for r in best}
    return per(regions, _to_centre(ship(centres)), longs("a", "ta", "b", "tb", "agree"), "a long, ta long, b long, tb long, agree long")


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in cut(b.column(2)):
                sets = [shingles(scan(b.column(i).slice(lo, hi - lo), lower=True), words) for i in (2, 3)]
                ok = []
                for i in range(hi - lo):
                    x, y = (h[off[i] : off[i + 1]] for h, off in sets)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, task_rows: int = TASK_ROWS) -> DataFrame:
    """A row for each document: id, ``n_shingles``, ``component_id``, ``kept``, and ``ord`` and ``th`` that tell its id and text.

    Documents are linked if their sets of distinct shingles of ``words`` words, A-Z folded, have a Jaccard similarity
    of ``percent`` or more. A shorter text is one shingle; a null or empty one has none and no
    links. component_id is the smallest id reachable. Rows that share an id are one document. Ids are below 2^62; a
    null id counts as a greater number that the row's text gives, so that only copies share it, and shows as
    null, as does a component of null ids alone; its copies are kept or not as one. Texts count whole. An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    known = bounded(docs).select(body.alias("text_"), numbered(F.col(key), body).alias("ord"), F.xxhash64(body).alias("th"))
    all_ = stored(known.mapInArrow(trimmed(_describe(words, 2)), "ord long, th long, n long, s1 long, s2 long, sig binary"))
    best = F.min(F.struct("ord", "th", "n", "sig")).alias("r")
    reps = stored(all_.where("n > 0").groupBy("s1", "s2").agg(best).select("s1", "s2", F.col("r.ord").alias("rep"), "r.th", "r.n", "r.sig"))

    prefixes = reps.select("rep", "sig").mapInArrow(trimmed(_prefixes), "prefix long, rep long")
    shared = stored(prefixes.groupBy("prefix").agg(F.count("*").alias("c")).where("c > 1").select("prefix"))
    tree = F.col("prefix").bitwiseAND(ORDERS - 1).cast("int")
    crowded = stored(partnered(prefixes, "prefix", shared).join(shared, "prefix").groupBy("rep").agg(F.collect_set(tree).alias("trees")))
    forest = stored(partnered(reps.select("rep", "th", "n", "sig"), "rep", crowded.select("rep")).join(crowded, "rep"))
    rows = stored(forest.select(F.explode("trees").alias("tree"), "sig", "rep", "th", "n").mapInArrow(trimmed(_turned), "tree int, sig binary, rep long, th long, n long"))
    order = ["tree", "sig", "rep"]
    size = crowded.agg(F.sum(F.size("trees"))).first()[0] or 0
    found = stored(rows.repartitionByRange(max(1, -(-size // task_rows)), *order).sortWithinPartitions(*order).mapInArrow(trimmed(_candidates(True)), PAIRS))
    # a few rows from either end of each partition, those of an order together
    ends = found.where("tree is not null").select("tree", "sig", F.col("a").alias("rep"), F.col("ta").alias("th"), "n").dropDuplicates(["tree", "rep"])
    centred = _centred(rows, found.where("tree is not null").select("tree", "sig", "agree"))
    across = ends.repartition(ORDERS, "tree").sortWithinPartitions(*order).mapInArrow(trimmed(_candidates(False)), PAIRS)
    candidates = found.where("tree is null").unionByName(across).select("a", "ta", "b", "tb", "agree")
    pairs = stored((candidates if centred is None else candidates.unionByName(centred)).groupBy("a", "ta", "b", "tb").agg(F.max("agree").alias("agree")))

    sides = pairs.select(F.col("a").alias("ord"), F.col("ta").alias("th")).unionByName(pairs.select(F.col("b").alias("ord"), F.col("tb").alias("th"))).distinct()
    sides = stored(sides)
    dropped(shared, crowded, forest, rows, found)
    wanted = stored(partnered(known, "th", sides.select("th")).join(sides, ["ord", "th"], "left_semi"))
    texts = wanted.dropDuplicates(["ord", "th"])

    def confirmed(p: DataFrame) -> DataFrame:
        """The links among pairs ``p``, a stored table; a text of many pairs goes to several tasks."""
        one = texts.select(F.col("ord").alias("b"), F.col("th").alias("tb"), F.col("text_").alias("y"))
        two = texts.select(F.col("ord").alias("a"), F.col("th").alias("ta"), F.col("text_").alias("x"))
        left, right = (["a", "ta"], hot(p, ["a", "ta"]), "u_"), (["b", "tb"], hot(p, ["b", "tb"]), "v_")
        both = dealt(dealt(p, *left), *right).join(copied(one, *right), ["b", "tb", "v_"]).join(copied(two, *left), ["a", "ta", "u_"])
        return both.select("a", "b", "x", "y").mapInArrow(trimmed(_confirm(words, percent)), "a long, b long")

    # each document's best candidate, the smaller id at a tie
    rank = lambda other: F.struct("agree", (-F.col(other)).alias("o"), "a", "ta", "b", "tb").alias("p")
    top = pairs.select(F.col("a").alias("x"), rank("b")).unionByName(pairs.select(F.col("b").alias("x"), rank("a"))).groupBy("x").agg(F.max("p").alias("p")).select("p.a", "p.ta", "p.b", "p.tb").distinct()
    top = stored(top)
    confirmed_ = stored(confirmed(top))
    # rows of one id with different sets, or copies of a set
    same = spread(all_.where("n > 0").select("s1", "s2", "ord"), reps.select("s1", "s2", "rep"), ["s1", "s2"]).where("ord <> rep").select(F.col("ord").alias("a"), F.col("rep").alias("b"))
    links = stored(confirmed_.unionByName(same))
    label = components(links)
    near = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    half = stored(spread(pairs, near("a"), ["a"], "left"))
    named = spread(half, near("b"), ["b"], "left")
    apart = named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "ta", "b", "tb")
    rest = stored(apart.join(top, ["a", "ta", "b", "tb"], "left_anti"))
    more = stored(confirmed(rest))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    dropped(reps, pairs, sides, wanted, top, confirmed_, links, half, rest, more)
    out = all_.join(label, all_["ord"] == label["node"], "left").withColumn("c", F.coalesce("component", "ord"))
    return out.select(F.when(F.col("ord") < NULL_ID, F.col("ord")).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("c") < NULL_ID, F.col("c")).alias("component_id"), (F.col("c") == F.col("ord")).alias("kept"), "ord", "th")


#: Of the registered query, which takes four words.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
c(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.comp FROM c JOIN l ON l.a = c.node)
SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(comp) AS component_id, min(comp) = node AS kept FROM c LEFT JOIN n ON n.doc_id = node GROUP BY node
"""
