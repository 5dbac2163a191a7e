"""SimHash near-duplicates through anchor points of a covering code.

Anchors are pairs of codewords of the binary Golay code on the first 46 bits of
a fingerprint: every half of 23 bits has exactly one codeword within the
covering radius 3. A fingerprint has its home at the anchor within the radius
of each half, and is replicated to every anchor within covering radius plus
threshold, the threshold shared between the halves. If two fingerprints differ
in at most ``threshold`` bits, each is at the other's home, so one comparison
per anchor finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm.common import stored

THRESHOLD = 2
SHINGLE = 3
SEED = 42
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
HALF = 23
RADIUS = 3
#: Homes, and members, of an anchor that one group holds at most, about: a larger anchor is cut into a grid of groups.
HOT = 8192


def fingerprint(text: str) -> int:
    """64 bits: one is set if it is set in over half of the shingles' XXH64; zero without words."""
    # On bytes, lower() changes A-Z alone and split() knows just the six blanks.
    w = text.encode().lower().split()
    n = len(w)
    if not n:
        return 0
    digest, k = xxhash.xxh64_intdigest, SHINGLE
    shingles = [b" ".join(w)] if n < k else map(b" ".join, zip(w, w[1:], w[2:]))
    h = np.array([digest(x, SEED) for x in shingles], "<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for any length
        part = h[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * bits > len(h)).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits). Null texts count as empty; a row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x or "") for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Codeword of every syndrome's coset leader, the parity table, and offsets by excess distance.

    ``offsets[e][s]``: all vectors v of weight RADIUS + e or less and over
    RADIUS + e - 1 with syndrome s, so that x ^ v is a codeword when s is the
    syndrome of x.
    """
    syndrome_of_bit = np.zeros(HALF, np.int64)
    for i in range(HALF):
        v = 1 << i
        for d in range(HALF - 1, 10, -1):
            if v >> d & 1:
                v ^= GOLAY << (d - 11)
        syndrome_of_bit[i] = v
    tables = []
    from itertools import combinations

    def spread(weights) -> list[np.ndarray]:
        out: list[list[int]] = [[] for _ in range(1 << 11)]
        for w in weights:
            for c in combinations(range(HALF), w):
                s = 0
                for i in c:
                    s ^= int(syndrome_of_bit[i])
                out[s].append(sum(1 << i for i in c))
        return out

    for e in range(THRESHOLD + 1):
        tables.append(spread(range(RADIUS + 1) if e == 0 else [RADIUS + e]))
    low = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for table, base, n in ((low, 0, 12), (high, 12, 11)):
        for i in range(n):
            table[1 << i : 2 << i] = table[: 1 << i] ^ syndrome_of_bit[base + i]
    return low, high, tables


def _syndrome(x: np.ndarray) -> np.ndarray:
    low, high, _ = _golay()
    return low[x & 0xFFF] ^ high[x >> 12 & 0x7FF]


@lru_cache(maxsize=1)
def _near() -> list[tuple[np.ndarray, np.ndarray]]:
    """By excess: offsets of all syndromes one after the other, and where each syndrome's begin."""
    out = []
    for table in _golay()[2]:
        counts = np.array([len(x) for x in table], np.int64)
        out.append((np.array([v for x in table for v in x], np.int64), np.concatenate([[0], np.cumsum(counts)])))
    return out


def _within(x: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for all codewords whose distance from x is RADIUS + excess, or up to RADIUS for 0."""
    values, begin = _near()[excess]
    s = _syndrome(x)
    n = begin[s + 1] - begin[s]
    row = np.repeat(np.arange(len(x)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s], n)
    return row, x[row] ^ values[at]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home): the anchors of each fingerprint, and whether it is at home there."""
    a, b = fp & ((1 << HALF) - 1), fp >> HALF & ((1 << HALF) - 1)
    rows, codes, home = [], [], []
    near_b = [_within(b, e) for e in range(THRESHOLD + 1)]
    for e in range(THRESHOLD + 1):
        row_a, code_a = _within(a, e)
        for g in range(THRESHOLD + 1 - e):
            row_b, code_b = near_b[g]
            # Pairs of codewords with one row: row_b is sorted, so a row's codewords are a slice of it.
            low, high = np.searchsorted(row_b, row_a), np.searchsorted(row_b, row_a, "right")
            n = high - low
            left = np.repeat(np.arange(len(row_a)), n)
            at = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            rows.append(row_a[left])
            codes.append(code_a[left] << HALF | code_b[at])
            home.append(np.full(len(left), e == 0 and g == 0))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(home)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 4096):
            part = fp[at : at + 4096]
            row, code, home = anchors(part)
            yield pa.record_batch([pa.array(code), pa.array(part[row]), pa.array(home)], ["anchor", "fp", "home"])


def _home_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        low, high = _within(fp & ((1 << HALF) - 1), 0)[1], _within(fp >> HALF & ((1 << HALF) - 1), 0)[1]
        yield pa.record_batch([pa.array(low << HALF | high)], ["anchor"])


def _forest(homes: np.ndarray, members: np.ndarray, threshold: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links between homes and members that join everything linked: at most one for each member."""
    us, vs = [], []
    label = np.arange(len(members))
    at = np.searchsorted(members, homes)
    for h, k in zip(homes.tolist(), at.tolist()):
        for b in range(0, len(members), 1 << 16):
            part = members[b : b + (1 << 16)]
            hit = np.flatnonzero(np.bitwise_count((part ^ h).view(np.uint64)) <= threshold) + b
            own = label[k] if k < len(members) and members[k] == h else -1
            new = hit[label[hit] != own]
            if len(new):
                _, first = np.unique(label[new], return_index=True)
                pick = new[first]
                us.append(np.full(len(pick), h))
                vs.append(members[pick])
                olds = label[new[first]]
                target = own if own >= 0 else olds.min()
                label[np.isin(label, olds)] = target
    return us, vs


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with one anchor and block; rows come sorted by them.

    Holds one group at a time, of about twice HOT rows at most.
    """
    rest: pa.Table | None = None

    def work(t: pa.Table) -> pa.RecordBatch:
        key = t.column("anchor").to_numpy()
        blk = t.column("block").to_numpy()
        fp = t.column("fp").to_numpy()
        home = t.column("home").to_numpy(zero_copy_only=False).astype(bool)
        edge = np.flatnonzero((key[1:] != key[:-1]) | (blk[1:] != blk[:-1])) + 1
        begin = np.concatenate([[0], edge])
        end = np.concatenate([edge, [len(key)]])
        size = end - begin
        us, vs = [], []
        # Small groups all at once: each member against the ones 1, 2, ... rows on.
        group = np.repeat(np.arange(len(begin)), size)
        small = size[group] <= 48
        for step in range(1, 48):
            a = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if len(key) > step else np.empty(0, np.int64)
            if not len(a):
                break
            b = a + step
            ok = (home[a] | home[b]) & (fp[a] != fp[b]) & (np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= THRESHOLD)
            us.append(fp[a[ok]])
            vs.append(fp[b[ok]])
        for g in np.flatnonzero(size > 48):
            x, h = fp[begin[g] : end[g]], home[begin[g] : end[g]]
            if h.any():
                more = _forest(np.unique(x[h]), np.unique(x), THRESHOLD)
                us += more[0]
                vs += more[1]
        u = np.concatenate(us) if us else np.empty(0, np.int64)
        v = np.concatenate(vs) if vs else np.empty(0, np.int64)
        pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        return pa.record_batch([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64())], ["u", "v"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key, blk = t.column("anchor").to_numpy(), t.column("block").to_numpy()
        cut = int(np.flatnonzero((key != key[-1]) | (blk != blk[-1]))[-1]) + 1 if len(key) and ((key != key[-1]) | (blk != blk[-1])).any() else 0
        if cut:
            yield work(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield work(rest)


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): links between distinct fingerprints (a column fp), enough to join all that are linked.

    An anchor with more homes or members than HOT is cut by hash into a grid of
    groups, of some homes and some members each: every home meets every member
    in one of them, and no task holds a crowded anchor whole.
    """
    if threshold != THRESHOLD:
        raise ValueError(f"the anchors are laid out for a threshold of {THRESHOLD}")
    # Only anchors where some fingerprint is at home can compare anything: the join drops the rest. Tables that
    # are joined are stored: the planner sends small ones to all and can split the hot keys of large ones.
    homes = stored(fps.select("fp").mapInArrow(_home_rows, "anchor long").distinct(), "homes")
    rows = fps.select("fp").mapInArrow(_anchor_rows, "anchor long, fp long, home boolean").join(homes, "anchor")
    rows = stored(rows.select("anchor", "fp", "home"), "members")
    cuts = lambda n: F.ceil(n / HOT).cast("int")
    hot = rows.groupBy("anchor").agg(cuts(F.count_if("home")).alias("h"), cuts(F.count("*")).alias("m")).filter("m > 1")
    rows = rows.join(stored(hot, "hot"), "anchor", "left").withColumns({"h": F.coalesce("h", F.lit(1)), "m": F.coalesce("m", F.lit(1))})
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    group = lambda i, j, home: F.struct((i * F.col("m") + j).alias("block"), home.alias("home"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(upto("h"), lambda i: group(i, part("m"), F.col("home") & (i == part("h"))))
    as_home = F.transform(F.filter(upto("m"), lambda j: F.col("home") & (j != part("m"))), lambda j: group(part("h"), j, F.lit(True)))
    rows = rows.select("anchor", "fp", F.explode(F.concat(as_member, as_home)).alias("g")).select("anchor", "g.block", "fp", "g.home")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "anchor", "block").sortWithinPartitions("anchor", "block", "fp")
    return rows.mapInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over the edges (u, v), for all nodes that have one.

    Each round links every node's larger neighbours, and the node itself, to its
    least neighbour, and then does so for the smaller ones; what is left is a
    star for each component. The number of rounds grows with the logarithm of a
    component's width; each makes progress, so there are no more than nodes. Rows
    are cut off from their lineage in the shared folder, and a node's least
    neighbour is stored before the join, in which a hub's rows can be split.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, rounds = None, 0
    while True:
        # Large star: over both directions, larger neighbours go to the least.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        # Small star: the smaller neighbours of a node, and the node, go to their least.
        m = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before, rounds = state, rounds + 1
        if rounds > 2 * state["n"] + 2:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least id reachable, its own included).

    A row per input row. Copies share a fingerprint and are linked through it
    without pairs. Empty, blank and null texts have fingerprint zero and link
    like any other. Null ids are kept and don't name a component unless no
    other id is in it. Texts of any length are read whole; repeated rows give a
    row each. Extra columns are ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, doc_id, text), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    comp = stored(components(links(groups)), "components")
    # Component ids follow from the least id of each fingerprint, not of each document.
    member = groups.join(comp, groups["fp"] == comp["node"])
    roots = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = comp.join(stored(roots, "roots"), "root").select("node", "component_id")
    ids = groups.join(named, groups["fp"] == named["node"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = fps.join(stored(ids, "ids"), "fp")  # stored, so that the rows of a hot fingerprint can be split
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
