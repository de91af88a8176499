"""N-gram Jaccard join with prefix trees.

Every text is the set of its distinct word n-grams (64-bit hashes; sets are compared pair by pair, so only collisions
inside one pair of texts could matter).  The plan:

1. ``sets``: one pass gives each document its set size and a digest of its set.  Equal sets form a class, which has a number.
2. ``shared``: a second pass deals the hashes to buckets as packed bytes (one set per class and block of documents).  A
   bucket knows how many sets have each hash and sends back those that at least two have.  Hashes that a
   noticeable part of all documents has skip the buckets: they are found from block counts.
3. The global order is (frequency, on a scale of 8 bits; hash); hashes that one set alone has come first and cannot match.  A
   set can only link if at least 75 % of it is shared, and two sets can only link if the first ``n - ceil(0.75 n) + 1`` hashes
   of each have one in common: these hashes tell which trees a set belongs to.
4. ``PrefixTree``: the ordered sets of a group are stored in a prefix tree (arrays of first child, next sibling, run of keys,
   least and greatest set size).  A set is joined with the whole tree in one walk: the overlap of a path is counted once for all
   sets below it, and a subtree is left where what remains of it or of the query cannot reach the overlap that the
   subtree's least size asks for.  Every link comes from such a walk.
5. Only connectivity is asked for, so sets that are connected already are not joined again: each set first goes into the tree of
   the pivot that most of its prefix hashes name, where all sets are joined with all; after that only sets of different
   components meet, those of a much shared hash in turns (a rising share of them as pivots, by a hash of their number), with
   components made anew in between.  No candidate is dropped.

Defined results: null, empty and wordless texts have no n-grams and are linked with nothing; a text with fewer words than an
n-gram is one n-gram; equal texts are linked (unless empty); every row is a document of its own and returned once, also where
ids are null or repeated, and a row's component is that of its text: the smallest id of all rows reachable from it (null where none
of them has an id); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batches, cut, discard, read, sized

WORDS = 5
#: A block of documents that a task works on at once.
BLOCK_DOCS, BLOCK_BYTES = 2048, 1_000_000
#: A hash that blocks with at least ``BLOCK_DOCS // FREQUENT`` sets of it have in one of so many documents (and in 200) is held
#: as frequent without a bucket.
FREQUENT = 512
#: Expected hashes in a bucket.
BUCKET = 1 << 20
#: Expected sets in a tree.
GROUP = 256
#: Up to so many pairs (24 bytes each) are broadcast to the sets; more are joined by a shuffle.
BROADCAST_PAIRS = 100_000
#: Expected pivots of a hash in the first turn, and how many times as many the next ones have.
TURN, MORE = 16, 256
#: Rows that a task of a small step handles: links and labels, and sets.
ROWS, SETS = 200_000, 10_000

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
_TABLES: dict[str, np.ndarray] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def _tables(n: int) -> dict[str, np.ndarray]:
    """A random number per byte, which bytes are white space, and powers of an odd base with their inverses."""
    if "power" not in _TABLES or len(_TABLES["power"]) < n:
        rng = np.random.default_rng(2024)
        _TABLES["byte"] = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        _TABLES["space"] = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
        size, base = 1 << max(20, (n - 1).bit_length()), 0x9E3779B97F4A7C15
        for name, factor in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
            powers = np.ones(size, _U)
            have = 1
            while have < size:
                step = min(have, size - have)
                powers[have : have + step] = powers[:step] * _U(pow(factor, have, 1 << 64))
                have += step
            _TABLES[name] = powers
    return _TABLES


def shingles(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: A-Z lower-cased, words between ASCII white space."""
    joined = b" " + b" ".join(texts).lower() + b" "
    t = _tables(len(joined))
    raw = np.frombuffer(joined, np.uint8)
    space = t["space"][raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.cumsum(t["byte"][raw] * t["power"][: len(raw)])
    words = _mix((sums[ends - 1] - sums[starts - 1]) * t["inverse"][starts]) if len(starts) else np.empty(0, _U)
    firsts = np.searchsorted(starts, np.cumsum([1] + [len(x) + 1 for x in texts]))  # of each text's words
    m = max(0, len(words) - n + 1)
    grams = np.zeros(m, _U)
    for k in range(n):
        grams += words[k : k + m] * _ODD[k % 8] ** _U(k // 8 + 1)
    grams = _mix(grams)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            whole = np.sum(words[a:b] * np.array([_ODD[k % 8] ** _U(k // 8 + 1) for k in range(b - a)])) + _U(b - a)
            out.append(_mix(np.array([whole], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _blocks(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of blocks of consecutive documents."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if texts and (len(texts) >= BLOCK_DOCS or size + len(text or b"") > BLOCK_BYTES):
                    yield ids, shingles(texts, n)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text or b"")
                size += len(texts[-1])
    if texts:
        yield ids, shingles(texts, n)


def _rows(kinds: list[pa.DataType], names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n, digest) of every document; besides, with a null digest, (hash, n): how many sets of a block have a frequent hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int64(), pa.binary(), pa.int64()], ["doc_id", "n", "digest", "hash"]
        for ids, found in _blocks(batches, n):
            yield _rows(kinds, names, [(i, len(g), digest(g), None) for i, g in zip(ids, found)])
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            often = counts >= max(2, BLOCK_DOCS // FREQUENT)
            yield _rows(kinds, names, [(None, c, None, h) for h, c in zip(values[often].view(np.int64).tolist(), counts[often].tolist())])

    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, digest binary, hash long")


def rank(counts: np.ndarray) -> np.ndarray:
    """Place of a number of sets on a scale of 8 bits: exact to 64, then eight steps for each doubling."""
    c = np.maximum(np.asarray(counts, np.float64), 1)
    return np.minimum(np.where(c < 64, c, 64 + np.floor(8 * np.log2(c / 64))), 255).astype(_U)


def _five(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def _owners(own: np.ndarray, documents: int) -> bytes:
    """Which document of a block each hash is of, in order: as counts of the documents, or as their numbers where that is shorter or a count too large."""
    counts = np.bincount(own, minlength=documents)
    if len(own) < documents or counts.max() > 0xFFFF:
        return b"\1" + own.astype("<u2").tobytes()
    return b"\0" + counts.astype("<u2").tobytes()


def _owned(raw: bytes) -> np.ndarray:
    values = np.frombuffer(raw, "<u2", offset=1).astype(np.int64)
    return values if raw[0] else np.repeat(np.arange(len(values)), values)


def shared(docs: DataFrame, frequent: np.ndarray, ranks: np.ndarray, bits: int, n: int = WORDS) -> DataFrame:
    """(digest, n, s, keys, prefix) of the sets that can link: keys are their shared hashes in the global order.

    Hashes keep 48 bits here, of which the first ``bits`` (at least 8) are the bucket.  Rows of step one: bucket, block,
    the documents that own the hashes, packed hashes.  A block's digests, sizes and frequent hashes take a bucket of its own.
    Blocks are consecutive rows of a partition, so ``docs`` should be read from files, where a repeated task sees the same order.
    """
    known = docs.sparkSession.sparkContext.broadcast((frequent, ranks.astype(_U) << _U(48)))  # at most FREQUENT times the mean set size
    rest = 48 - bits
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["bucket", "block", "counts", "data"]
    schema = "bucket long, block long, counts binary, data binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (often, place), part = known.value, TaskContext.get().partitionId()
        for number, (_, found) in enumerate(_blocks(batches, n)):
            block = part << 32 | number
            by = {digest(g): g for g in found if len(g)}  # one set per class
            if not by:
                continue
            grams = np.concatenate(list(by.values()))
            own = np.repeat(np.arange(len(by)), [len(g) for g in by.values()])
            if len(often):
                at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                common = often[at] == grams
                often_keys = (grams[common] >> _U(16)) | place[at[common]]
            else:
                common, often_keys = np.zeros(len(grams), bool), grams[:0]
            tokens = grams >> _U(16)
            heads = b"".join(k + len(g).to_bytes(8, "little") for k, g in by.items())
            counted = np.bincount(own[common], minlength=len(by)).astype("<u4").tobytes()
            rows = [(-1 - block, block, None, heads), (-1 - block, block, counted, often_keys.tobytes())]
            tokens, own = tokens[~common], own[~common]
            order = np.argsort((tokens >> _U(rest)).astype(np.int32), kind="stable")
            tokens, own = tokens[order], own[order]
            buckets = (tokens >> _U(rest)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.empty(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(buckets)]):
                rows.append((int(buckets[a]), block, _owners(own[a:b], len(by)), _five(tokens[a:b] & _U((1 << rest) - 1))))
            yield _rows(kinds, names, rows)

    def count(table: pa.Table) -> pa.Table:
        bucket, blocks, counts, data = (c.to_pylist() for c in table.columns)
        if bucket[0] < 0:
            return table
        parts = [_eight(d) for d in data]
        tokens = np.concatenate(parts)
        _, inverse, sizes = np.unique(tokens, return_inverse=True, return_counts=True)
        sizes = sizes[inverse]
        rows, at = [], 0
        for block, c, x in zip(blocks, counts, parts):
            mine = sizes[at : at + len(x)]
            keep = mine > 1
            keys = rank(mine[keep]) << _U(48) | _U(bucket[0] << rest) | x[keep]
            if len(keys):
                rows.append((bucket[0], block, np.bincount(_owned(c)[keep]).astype("<u4").tobytes(), keys.tobytes()))
            at += len(x)
        return pa.Table.from_batches([_rows(kinds, names, rows)])

    def gather(table: pa.Table) -> pa.Table:
        heads, own, keys = b"", [], []
        for c, d in zip(table.column("counts").to_pylist(), table.column("data").to_pylist()):
            if c is None:
                heads = d
            else:
                count = np.frombuffer(c, "<u4")
                own.append(np.repeat(np.arange(len(count)), count))
                keys.append(np.frombuffer(d, "<u8"))
        own, keys, rows = np.concatenate(own), np.concatenate(keys), []
        order = np.lexsort((keys, own))
        own, keys = own[order], keys[order]
        edges = np.searchsorted(own, np.arange(len(heads) // 24 + 1)).tolist()
        for k in range(len(heads) // 24):
            name, size = heads[24 * k : 24 * k + 16], int.from_bytes(heads[24 * k + 16 : 24 * k + 24], "little")
            x = keys[edges[k] : edges[k + 1]]
            needed = -(-3 * size // 4)
            prefix = size - needed + 1 - (size - len(x))
            if len(x) >= needed and prefix > 0:
                rows.append((name, size, len(x), x.tobytes(), x[:prefix].view(np.int64)))
        return pa.Table.from_batches([_rows([pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], ["digest", "n", "s", "keys", "prefix"], rows)])

    dealt = by_batches(docs.select("doc_id", "text"), deal, schema)
    counted = dealt.groupBy("bucket").applyInArrow(count, schema)
    found = counted.groupBy("block").applyInArrow(gather, "digest binary, n long, s long, keys binary, prefix array<long>")
    return found.dropDuplicates(["digest"])


class PrefixTree:
    """Globally ordered sets as a prefix tree whose edges are runs of keys.

    Node 0 is the root.  Node ``v`` adds the keys ``begin[v]`` to ``end[v]`` of the set ``leaf[v]`` to its parent's path; below it
    are the sets ``order[low[v]:high[v]]``, of ``least[v]`` n-grams at least and with ``longest[v]`` keys at most.
    """

    def __init__(self, sizes: list[int], keys: list[np.ndarray]):
        raw = [k.astype(">u8").tobytes() for k in keys]
        self.order = sorted(range(len(keys)), key=raw.__getitem__)
        self.sizes, self.keys = [sizes[i] for i in self.order], [keys[i] for i in self.order]
        self.begin, self.end, self.leaf = [0], [0], [0]
        self.first_child, self.next_sibling, self.terminals = [-1], [-1], [[]]
        path, before = [0], None
        for i, x in enumerate(self.keys):
            depth = 0
            if before is not None:
                short = min(len(x), len(before))
                differ = np.flatnonzero(x[:short] != before[:short])
                depth = int(differ[0]) if len(differ) else short
            while len(path) > 1 and self.begin[path[-1]] >= depth:
                path.pop()
            at = path[-1]
            if self.end[at] > depth:  # the run of keys splits where the new set leaves it
                lower = self._add(depth, self.end[at], self.leaf[at])
                self.first_child[lower], self.terminals[lower] = self.first_child[at], self.terminals[at]
                self.end[at], self.first_child[at], self.terminals[at] = depth, lower, []
            if len(x) > depth:
                new = self._add(depth, len(x), i)
                self.next_sibling[new], self.first_child[at] = self.first_child[at], new
                path.append(new)
                at = new
            self.terminals[at].append(i)
            before = x
        self._bounds()

    def _add(self, begin: int, end: int, leaf: int) -> int:
        for column, value in ((self.begin, begin), (self.end, end), (self.leaf, leaf), (self.first_child, -1), (self.next_sibling, -1), (self.terminals, [])):
            column.append(value)
        return len(self.begin) - 1

    def children(self, node: int) -> Iterator[int]:
        child = self.first_child[node]
        while child >= 0:
            yield child
            child = self.next_sibling[child]

    def _bounds(self) -> None:
        nodes, stack = [], [0]
        while stack:
            nodes.append(stack.pop())
            stack.extend(self.children(nodes[-1]))
        n = len(self.begin)
        self.low, self.high, self.least, self.longest = [len(self.sizes)] * n, [0] * n, [1 << 62] * n, [0] * n
        for v in reversed(nodes):  # children come after their parent
            own = self.terminals[v]
            parts = [(i, i + 1, self.sizes[i], len(self.keys[i])) for i in own] + [(self.low[c], self.high[c], self.least[c], self.longest[c]) for c in self.children(v)]
            if parts:
                low, high, least, longest = zip(*parts)
                self.low[v], self.high[v], self.least[v], self.longest[v] = min(low), max(high), min(least), max(longest)

    def join(self, query: np.ndarray, size: int, settled: np.ndarray) -> list[int]:
        """Places (in ``order``) of the sets, but for ``settled`` ones, whose similarity to the query is at least 0.75."""
        found, stack = [], [(0, 0, 0)]  # node, overlap of its parent's path, keys of the query that the path has passed
        while stack:
            node, overlap, passed = stack.pop()
            if settled[self.low[node] : self.high[node]].all():
                continue
            run, k, end, longest = self.keys[self.leaf[node]], self.begin[node], self.end[node], self.longest[node]
            needed = -(-3 * (size + self.least[node]) // 7)
            while overlap + min(longest - k, len(query) - passed) >= needed:
                if k == end:
                    for i in self.terminals[node]:
                        if 7 * overlap >= 3 * (size + self.sizes[i]) and not settled[i]:
                            found.append(i)
                    stack.extend((child, overlap, passed) for child in self.children(node))
                    break
                step = run[k : min(k + 64, end)]
                at = np.searchsorted(query, step)
                overlap += int((query[np.minimum(at, len(query) - 1)] == step).sum())
                passed = int(np.searchsorted(query, step[-1], "right"))
                k += len(step)
        return found


def tree_links(sizes: list[int], keys: list[np.ndarray], queries: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Links, as pairs of labels, that join the labels of sets which a walk through their tree from one of ``queries`` finds linked."""
    if len(set(labels)) < 2:
        return []
    tree = PrefixTree(sizes, keys)
    place = {i: at for at, i in enumerate(tree.order)}
    group = np.unique(np.array([labels[i] for i in tree.order], np.int64), return_inverse=True)[1]
    asked, links = np.zeros(len(sizes), bool), []
    for i in queries:
        own = group[place[i]]
        asked[place[i]] = True
        for at in tree.join(keys[i], sizes[i], asked | (group == own)):
            if group[at] != own:
                links.append((labels[i], labels[tree.order[at]]))
                group[group == group[at]] = own
        if (group == own).all():
            break
    return links


def verify(pairs: DataFrame, stored: DataFrame, every: bool) -> DataFrame:
    """The links (x, y) between components that trees find.

    A tree holds the pivot ``a`` and its candidates ``b`` of ``pairs`` (a, b, component_a, component_b), at most about ``GROUP`` of them; it is asked
    for the pivot alone or for ``every`` set in it.  ``stored`` is (id, n, keys).
    """
    rows = pairs.count()
    loads = pairs.groupBy("a", "component_a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    loads = sized(loads, rows, ROWS)
    dealt = pairs.join(loads.drop("component_a"), "a").select("a", F.pmod(F.xxhash64("b"), "groups").alias("part"), "b", F.col("component_b").alias("component"))
    own = loads.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("component_a").alias("component"))
    wanted = dealt.unionByName(own).withColumn("id", F.coalesce("b", "a"))
    if rows <= BROADCAST_PAIRS:  # then the sets stay where they are
        wanted = F.broadcast(wanted)
    members = stored.join(wanted, "id").select("a", "part", "b", "component", "n", "keys")

    def run(table: pa.Table) -> pa.Table:
        ids, labels, sizes, keys = (table.column(c).to_pylist() for c in ("b", "component", "n", "keys"))
        queries = [i for i, b in enumerate(ids) if b is None]
        queries += [i for i, b in enumerate(ids) if b is not None] if every else []
        links = tree_links(sizes, [np.frombuffer(k, "<u8") for k in keys], queries, labels)
        return pa.table({c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate("xy")})

    return sized(members.groupBy("a", "part").applyInArrow(run, "x long, y long"), rows, SETS)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as links to the least of those that they connect."""
    for batch in batches:
        parent: dict[int, int] = {}

        def top(i: int) -> int:
            while parent.setdefault(i, i) != i:  # noqa: B023
                parent[i] = i = parent[parent[i]]  # noqa: B023
            return i

        for x, y in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = top(x), top(y)
            parent[max(a, b)] = min(a, b)
        found = [(i, top(i)) for i in parent if top(i) != i]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["x", "y"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (id, component) after ``links`` (x, y) between components: every component takes the least that it reaches.

    Each round every component takes the least neighbouring one, then pointers are halved; all of it on stored tables.
    """
    edges = links.mapInArrow(_forest, "x long, y long")
    edges = cut(edges.union(edges.select("y", "x")), "edges")
    n = edges.count()
    if not n:
        discard(edges)
        return nodes
    fit = lambda df: sized(df, n, ROWS)
    labels = cut(fit(edges.groupBy(F.col("x").alias("id")).agg(F.least("id", F.min("y")).alias("label"))), "labels")
    while True:
        ends = labels.select(F.col("id").alias("x"), F.col("label").alias("from")), labels.select(F.col("id").alias("y"), F.col("label").alias("to"))
        apart = edges.join(ends[0], "x").join(ends[1], "y").where("from > to").select("x", "to")
        if apart.isEmpty():
            break
        heard = fit(apart.groupBy("x").agg(F.min("to").alias("heard")))
        new = labels.join(heard, labels["id"] == heard["x"], "left").select("id", F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("next"))
        new = new.join(jump, new["label"] == jump["at"], "left").select("id", F.least("label", "next").alias("label"))
        old, labels = labels, cut(fit(new), "labels")
        discard(old)
    final = labels.select(F.col("id").alias("component"), "label")
    out = cut(nodes.join(final, "component", "left").select("id", F.coalesce("label", "component").alias("component")), "components")
    discard(edges, labels)
    return out


def _can(side: str, other: str) -> Column:
    """Whether sets whose first common hash has the places ``pos`` can reach the overlap that their sizes ask for."""
    n, m, p, q = (F.col(c) for c in (f"n_{side}", f"n_{other}", f"pos_{side}", f"pos_{other}"))
    needed = F.ceil(3 * (n + m) / 7)
    return (n - p >= needed) & (m - q >= needed)


def link(stored: DataFrame) -> DataFrame:
    """(id, component) of the sets of ``stored`` (id, n, s, keys, prefix).

    ``pos`` is a prefix hash's place in the global order of its set.  If it is the first that two sets share, no more than what
    follows in either can be common; a pair that can link passes this test at its first common hash.
    """
    sets = stored.select("id", "n", "keys")
    count = stored.count()
    share = (-F.col("s") / F.col("n")).alias("share")
    posting = stored.select("id", "n", share, F.col("n") - F.col("s"), F.posexplode("prefix")).toDF("id", "n", "share", "alone", "pos", "hash")
    posting = posting.select("hash", "id", "n", "share", (F.col("alone") + F.col("pos")).alias("pos"))
    side = lambda df, x, *more: df.select("hash", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", *more)])
    # first: each set and the pivot that most of its prefix hashes name
    best = posting.groupBy("hash").agg(F.min(F.struct("share", "id", "n", "pos")).alias("pivot"), F.count("*").alias("c")).where("c > 1")
    best = best.select("hash", *[F.col(f"pivot.{c}").alias(f"{c}_a") for c in ("id", "n", "pos")])
    named = side(posting, "b").join(best, "hash").where(F.col("id_a") != F.col("id_b")).where(_can("a", "b"))
    named = named.groupBy("id_b", "id_a").agg(F.count("*").alias("c"))
    first = named.groupBy("id_b").agg(F.max_by("id_a", F.struct("c", -F.col("id_a"))).alias("a"))
    first = first.select("a", F.col("id_b").alias("b"), F.col("a").alias("component_a"), F.col("id_b").alias("component_b"))
    nodes = stored.select("id", F.col("id").alias("component"))
    first = cut(sized(first, count, ROWS), "first")
    nodes = components(nodes, verify(first, sets, True))
    discard(first)
    # then: sets of different components with a common hash, where a hash has many in turns.  ``turn`` is spread evenly over 0 to 1;
    # of two sets the one with the smaller turn is the pivot, and a hash is through when all turns have been pivots.
    waiting = posting.withColumns({"turn": F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(1 << 30), "done": F.lit(0.0)}).drop("share")
    pivots, before = TURN, None
    while True:
        rows = waiting.join(nodes, "id")
        # sets that cannot reach the overlap with the smallest fitting set of the hash have no pair there
        by = rows.groupBy("hash").agg(F.min("n").alias("least"), F.min("component").alias("one"), F.max("component").alias("other"), F.count("*").alias("m"))
        by = by.where("one <> other").select("hash", "least", F.least(F.lit(1.0), pivots / F.col("m")).alias("until"))
        partner = F.greatest("least", F.ceil(0.75 * F.col("n")))
        rows = rows.join(by, "hash").where(F.col("n") - F.col("pos") >= F.ceil(3 * (F.col("n") + partner) / 7)).drop("least")
        rows = cut(sized(rows, 8 * count, ROWS), "rows")
        a = side(rows.where("turn >= done and turn < until"), "a", "component", "turn")
        b = side(rows, "b", "component", "turn")
        order = F.struct("turn_a", "id_a") < F.struct("turn_b", "id_b")
        pairs = a.join(b, "hash").where(order & (F.col("component_a") != F.col("component_b")) & _can("a", "b"))
        pairs = pairs.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.first("component_a").alias("component_a"), F.first("component_b").alias("component_b"))
        pairs = cut(sized(pairs, 8 * count, ROWS), "pairs")
        if not pairs.isEmpty():
            nodes = components(nodes, verify(pairs, sets, False))
        discard(pairs, *([before] if before is not None else []))
        before = rows
        waiting = rows.where("until < 1").select("hash", "id", "n", "pos", "turn", F.col("until").alias("done"))
        if waiting.isEmpty():
            return nodes
        pivots *= MORE


def join(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = cut(sets(docs, n), "sets")
    table = first.where("digest is not null").select("doc_id", "n", "digest")
    total, rows = (x or 0 for x in table.agg(F.sum("n"), F.count("*")).first())
    least = max(200, rows // FREQUENT)
    often = first.where("digest is null").groupBy("hash").agg(F.sum("n").alias("n"))
    # at most FREQUENT times the mean set size
    often = sorted((r["hash"] % (1 << 64), r["n"]) for r in sized(often, rows, ROWS).where(F.col("n") >= least).collect())
    bits = max(8, int(np.ceil(np.log2(max(total, 1) / BUCKET)))) if total else 8
    classes = table.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"))
    classes = cut(sized(classes, rows, ROWS).withColumn("id", F.monotonically_increasing_id()), "classes")
    keys = shared(docs, np.array([h for h, _ in often], _U), rank(np.array([c for _, c in often])), min(bits, 40), n)
    nodes = link(cut(sized(keys.join(classes.select("digest", "id"), "digest").drop("digest"), rows, SETS), "stored"))
    top = classes.join(nodes, "id").groupBy("component").agg(F.min("doc").alias("top"))
    linked = nodes.join(sized(top, rows, ROWS), "component").select("id", "top")
    named = classes.join(linked, "id", "left").select(F.col("digest").alias("d"), F.coalesce("top", "doc").alias("top"))
    out = table.join(named, (table["digest"] == F.col("d")) & (table["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents", "doc_id", "text"))
