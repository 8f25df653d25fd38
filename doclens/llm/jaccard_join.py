"""N-gram Jaccard join by PartEnum signatures.

Two documents link when the Jaccard similarity of their word-shingle sets reaches a
threshold. Sets fall into size bands so narrow that linked sets lie in the same or in
adjacent bands. For a band, the threshold is a bound ``k`` on the symmetric difference.
The shingle domain is cut into ``n1`` partitions of ``n2`` sub-partitions: in some
partition two linked sets differ in at most ``k2`` shingles, hence agree on ``n2 - k2`` of its
sub-partitions, and so share one of the enumerated signatures. No link is lost.

The plan never pairs up a bucket of equal signatures:

1. Equal sets become one node. Signatures are aggregated to their smallest and largest node
   (combined before the shuffle); those of one node only are done with.
2. Each node of a shared signature is compared with the smallest node of it. A parity
   sketch bounds the symmetric difference from below and drops most pairs; exact sets
   decide the rest. The links give components.
3. Signatures whose nodes still lie in several components are looked at once more. Those of a
   handful of nodes give their pairs of different components, each pair once, which take the
   same two tests. In larger ones blocks of nodes compare sketches inside a task, and only nodes
   with a partner in another component that the sketch can't exclude go on, with their exact
   sets; pairs never leave the task, but for links between components. Then nothing is
   left to test.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.base import Bitmap, bitmap, discard, query, release_shuffles, table, tasks, wide_rows
from doclens.llm.components import compact, components
from doclens.llm.words import Words, chunks, mix, shingles, text_bytes
from doclens.session import written

_U = np.uint64
TEXT_BYTES = 1 << 18  # of texts whose sets and signatures a task makes at once; their signatures take many times as much
FEW = 8  # nodes of a signature whose pairs go on as rows, each pair once
BLOCK = 2048  # nodes of a signature that a task compares with another such block,
BLOCK_ELEMENTS = 1 << 20  # or as many as hold so many shingles together


class Scheme:
    """Size bands and signature parameters for ``den * shared >= num * all``, with ``num / den`` the threshold."""

    def __init__(self, num: int, den: int, size: int, seed: int = 0):
        if not 0 < num <= den:
            raise ValueError("the threshold must be in (0, 1]")
        self.num, self.den, self.size, self.seed = num, den, size, seed
        self.starts, self.ends, self.bounds = [1], [den // num], [self._bound(2, 2 * (den // num))]

    def allowed(self, total):
        """The largest symmetric difference of two linked sets with ``total`` elements in both."""
        return total - 2 * (-(-self.num * total // (self.num + self.den)))

    def _bound(self, low: int, high: int) -> int:
        # rises with the total but for steps of the rounding, so the last totals hold the maximum
        totals = np.arange(max(low, high - 4 * self.den), high + 1, dtype=np.int64)
        return int(self.allowed(totals).max())

    def grow(self, largest: int) -> None:
        while self.ends[-1] < largest or len(self.starts) < 2 or self.ends[-2] < largest:
            low = self.ends[-1] + 1
            self.starts.append(low)
            self.ends.append(max(low, low * self.den // self.num))
            self.bounds.append(self._bound(2, 2 * self.ends[-1]))

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.starts), sizes, "right") - 1

    @staticmethod
    def levels(k: int) -> tuple[int, int, int, int]:
        """``(n1, n2, k2, spare)``: partitions, sub-partitions, those that may differ, partitions beyond the need."""
        if k == 0:
            return 1, 1, 0, 0
        if k <= 8:
            return k // 3 + 1, 5, 2, 0
        spare = 2 + k // 64
        return k // 2 + 1 + spare, 2, 1, spare

    def sketch_bits(self, band: int) -> int:
        return min(8192, max(64, 1 << (16 * self.bounds[band] - 1).bit_length()))

    def node(self, values: np.ndarray) -> tuple[int, int]:
        """Two independent fingerprints of a set; the first is the node."""
        seed = _U(2 * self.seed + 1)
        a = mix(np.array([mix(values ^ seed).sum(dtype=np.uint64) + _U(len(values))], np.uint64))
        b = mix(np.array([mix(values + _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64))
        return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``(signature, set number)`` of non-empty sets, each for its own band and the next."""
        sizes = np.array([len(s) for s in sets])
        if not len(sizes):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.grow(int(sizes.max()))
        bands = self.band(sizes)
        out, owners = [], []
        for instance in range(int(bands.min()), int(bands.max()) + 2):
            own = np.flatnonzero((bands == instance) | (bands == instance - 1))
            if not len(own):
                continue
            n1, n2, k2, spare = self.levels(self.bounds[instance])
            values = np.concatenate([sets[i] for i in own])
            owner = np.repeat(np.arange(len(own)), sizes[own])
            place = ((mix(values ^ _U(0xA5A5 + instance)) >> _U(32)) * _U(n1 * n2)) >> _U(32)
            cell = owner * (n1 * n2) + place.astype(np.int64)
            sums = np.zeros(len(own) * n1 * n2, np.uint64)
            np.add.at(sums, cell, mix(values ^ _U(0x1234567)))
            held = np.bincount(cell, minlength=len(sums)).reshape(len(own), n1, n2)
            sums = sums.reshape(len(own), n1, n2)
            codes = np.arange(n1, dtype=np.uint64)
            picked, empty = [], []
            for number, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
                code = _U(instance << 40 | number << 32)
                total = mix(codes | code)[None, :] + np.zeros((len(own), 1), np.uint64)
                for sub in subset:
                    total = mix(total + sums[:, :, sub] + _U(sub + 1))
                picked.append(total)
                empty.append(held[:, :, list(subset)].sum(axis=2) == 0)
            picked, empty = np.stack(picked, 2), np.stack(empty, 2)
            # linked sets agree in at least spare + 1 partitions: signatures of nothing
            # are needed only where more partitions than the spare ones have such
            few = empty.any(axis=2).sum(axis=1) <= spare
            use = ~empty | ~few[:, None, None]
            out.append(picked[use])
            owners.append(np.broadcast_to(own[:, None, None], use.shape)[use])
        return np.concatenate(out), np.concatenate(owners)

    def sketch(self, values: np.ndarray) -> np.ndarray:
        """Parity of the set's elements per hashed cell, as words; cells differ at most as often as sets do."""
        self.grow(len(values))
        bits = self.sketch_bits(int(self.band(np.array([len(values)]))[0]))
        cells = (mix(values ^ _U(0x77777)) & _U(bits - 1)).astype(np.int64)
        parity = (np.bincount(cells, minlength=bits) & 1).astype(np.uint8)
        return np.packbits(parity, bitorder="little").view(np.uint64)

    def sets(self, batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
        data, offsets = text_bytes(batch.column(text))
        words = Words(data, offsets, lower=True)
        return shingles(words.hashes(), words.counts, self.size)


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer cells from one of more; both counts are powers of two."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _signature_rows(docs: DataFrame, scheme: Scheme, text: str, only: Bitmap | None) -> DataFrame:
    """``(sig, node)``: the signatures of every text; with ``only``, those that may be in the bitmap."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in chunks(batches, text, TEXT_BYTES):
            sets, nodes = [], []
            for values in scheme.sets(part, text):
                if not len(values):
                    continue
                node = scheme.node(values)[0]
                if node not in seen:  # copies met in the same task
                    seen.add(node)
                    sets.append(values)
                    nodes.append(node)
            if len(seen) > 1_000_000:
                seen.clear()
            sigs, owners = scheme.signatures(sets)
            owner_nodes = np.array(nodes, np.int64)[owners] if len(nodes) else np.zeros(0, np.int64)
            if only is not None:
                hit = only.has(sigs)
                sigs, owner_nodes = sigs[hit], owner_nodes[hit]
            for at in range(0, len(sigs), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs[at : at + 200_000].view(np.int64)), pa.array(owner_nodes[at : at + 200_000])], ["sig", "node"]
                )

    return docs.select(text).mapInArrow(emit, "sig long, node long")


def _membership(docs: DataFrame, scheme: Scheme, id_column: str, text: str, only: Bitmap) -> DataFrame:
    """One row per document: ``(id, node, check, n)``, with sketch and set where the node may be in the bitmap."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in chunks(batches, text, TEXT_BYTES):
            rows = []
            for values in scheme.sets(part, text):
                if not len(values):
                    rows.append((None, None, 0, None, None))
                    continue
                node, check = scheme.node(values)
                want = node not in seen and only.has(np.array([node], np.int64))[0]
                if want:
                    seen.add(node)
                rows.append((node, check, len(values), scheme.sketch(values).tobytes() if want else None, values.tobytes() if want else None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [part.column(id_column), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["id", "node", "check", "n", "sketch", "elements"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(
        emit, f"id {kind}, node long, `check` long, n long, sketch binary, elements binary"
    )


def _sketch_test(scheme: Scheme):
    """Keeps rows whose sizes and sketches allow a link; columns a, b, na, nb, sa, sb."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sizes = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            for na, nb, sa, sb in sizes:
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                w = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum())
                keep.append(scheme.den * min(na, nb) >= scheme.num * max(na, nb) and apart <= scheme.allowed(na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return emit


def _exact_test(scheme: Scheme):
    """Keeps pairs whose sets link; columns a, b, ea, eb."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ea, eb in zip(batch.column("ea"), batch.column("eb")):
                x, y = np.frombuffer(ea.as_buffer(), np.uint64), np.frombuffer(eb.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(scheme.den * shared >= scheme.num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return emit


def _likely(pairs: DataFrame, light: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes and sketches allow a link."""
    tested = pairs.join(light.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").join(
        light.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a"
    )
    return tested.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_sketch_test(scheme), "a long, b long")


def _few_pairs(scheme: Scheme):
    """Pairs of different components that share a signature of few nodes and whose sizes allow a link; rows come by signature."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((4, 0), np.int64)
        found: list[np.ndarray] = []
        held = 0
        for batch in batches:
            rows = np.concatenate((tail, np.stack([batch.column(c).to_numpy() for c in ("sig", "node", "component", "n")])), axis=1)
            sig, node, component, n = rows
            for step in range(1, FEW):
                x = np.arange(max(0, rows.shape[1] - step))
                # pairs inside what is carried over were found before
                x = x[(x + step >= tail.shape[1]) & (sig[x] == sig[x + step])] if len(x) else x
                y = x + step
                low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                keep = (component[x] != component[y]) & (node[x] != node[y]) & (scheme.den * low >= scheme.num * high)
                found.append(np.stack((np.minimum(node[x], node[y])[keep], np.maximum(node[x], node[y])[keep]), 1))
                held += len(found[-1])
            tail = rows[:, -(FEW - 1) :]
            if held > 1_000_000:
                yield _as_pairs(found)
                found, held = [], 0
        yield _as_pairs(found)

    return emit


def _as_pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs ``(a, b)`` whose exact sets link."""
    sets = nodes.select("node", "elements")
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b"
    )
    return joined.select("a", "b", "ea", "eb").mapInArrow(_exact_test(scheme), "a long, b long")


class _Block:
    """Rows of signature buckets, in the order of (sig, lo, hi, node), with their sketches side by side."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.table = table
        column = {c: table.column(c).to_numpy() for c in ("sig", "lo", "hi", "node", "component", "n", "block")}
        self.node, self.component, self.n, self.block = (column[c] for c in ("node", "component", "n", "block"))
        self.lo, self.hi = column["lo"], column["hi"]
        keys = np.stack([column[c] for c in ("sig", "lo", "hi")])
        self.edges = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
        sketches = table.column("sketch").chunk(0).cast(pa.large_binary()) if len(table) else pa.array([], pa.large_binary())
        offsets = np.frombuffer(sketches.buffers()[1], np.int64)[sketches.offset : sketches.offset + len(table) + 1] if len(table) else np.zeros(1, np.int64)
        self.words = np.diff(offsets) >> 3
        self.flat = np.frombuffer(sketches.buffers()[2], np.uint64) if len(table) else np.zeros(0, np.uint64)
        self.at = offsets[:-1] >> 3

    def _sketches(self, rows: np.ndarray, words: int, width: int) -> np.ndarray:
        full = self.flat[self.at[rows][:, None] + np.arange(words)]
        return full if words == width else np.bitwise_xor.reduce(full.reshape(len(rows), -1, width), axis=1)

    def near(self, scheme: Scheme, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row pairs of different components that sizes and sketches allow to link."""
        keep = (self.component[x] != self.component[y]) & (self.node[x] != self.node[y])
        low, high = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
        keep &= scheme.den * low >= scheme.num * high
        x, y = x[keep], y[keep]
        limit = scheme.allowed(low[keep] + high[keep])
        allowed = np.zeros(len(x), bool)
        shapes = self.words[x] << 32 | self.words[y]
        for shape in np.unique(shapes).tolist():
            wx, wy = shape >> 32, shape & 0xFFFFFFFF
            width = min(wx, wy)
            own = np.flatnonzero(shapes == shape)
            for part in np.array_split(own, max(1, len(own) * max(wx, wy) >> 20)):
                apart = np.bitwise_count(self._sketches(x[part], wx, width) ^ self._sketches(y[part], wy, width)).sum(axis=1)
                allowed[part] = apart <= limit[part]
        return x[allowed], y[allowed]

    def candidates(self, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All near pairs, a bounded number of compared pairs at a time; no pair of rows meets twice in a bucket."""
        sizes = np.diff(self.edges)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        few = sizes <= 32
        rows = np.flatnonzero(few[bucket] & (self.lo == self.hi))
        for step in range(1, 32):
            x = rows[rows + step < len(bucket)]
            x = x[bucket[x] == bucket[x + step]]
            if not len(x):
                break
            yield self.near(scheme, x, x + step)
        for i in np.flatnonzero(~few | (self.lo[self.edges[:-1]] != self.hi[self.edges[:-1]])).tolist():
            own = np.arange(self.edges[i], self.edges[i + 1])
            left, right = own[self.block[own] == self.lo[own[0]]], own[self.block[own] == self.hi[own[0]]]
            same = self.lo[own[0]] == self.hi[own[0]]
            step = max(1, (1 << 19) // max(1, len(right)))
            for at in range(0, len(left), step):
                x, y = np.repeat(left[at : at + step], len(right)), np.tile(right, len(left[at : at + step]))
                if same:
                    x, y = x[x < y], y[x < y]
                yield self.near(scheme, x, y)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables of whole (sig, lo, hi) buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "lo", "hi")])
        last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut == 0 and held:  # maybe the same bucket as what is held: a bucket has a bounded number of rows
            before = tuple(held[-1].column(c)[-1].as_py() for c in ("sig", "lo", "hi"))
            if before != tuple(keys[:, 0].tolist()):
                yield pa.Table.from_batches(held)
                held = []
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _near_rows(scheme: Scheme):
    """The rows of each bucket that have a near pair there."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buckets(batches):
            block = _Block(table)
            hit = np.zeros(len(table), bool)
            for x, y in block.candidates(scheme):
                hit[x] = hit[y] = True
            yield from block.table.filter(pa.array(hit)).to_batches()

    return emit


class _Forest:
    """What a task has found to be connected."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        top = node
        while (up := self.parent.get(top, top)) != top:
            top = up
        while (up := self.parent.get(node, node)) != top:
            self.parent[node] = top
            node = up
        return top

    def join(self, a: int, b: int) -> None:
        self.parent[a] = b


def _linked_rows(scheme: Scheme):
    """Links between components by the exact sets: a spanning forest of a task's, so one link fewer than components at most.

    Pairs that are connected by links found before need no test. Columns of the buckets and ``elements``.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for table in _buckets(batches):
            block = _Block(table)
            elements = block.table.column("elements")
            sets = [np.frombuffer(e.as_buffer(), np.uint64) for e in elements]
            names, place = np.unique(block.component, return_inverse=True)
            root = np.array([forest.root(c) for c in names.tolist()], np.int64)[place]
            links = []
            for xs, ys in block.candidates(scheme):
                for at in range(0, len(xs), 1024):
                    x, y = xs[at : at + 1024], ys[at : at + 1024]
                    apart = root[x] != root[y]
                    for i, j in zip(x[apart].tolist(), y[apart].tolist()):
                        a, b = root[i], root[j]
                        if a == b:
                            continue
                        both = np.concatenate((sets[i], sets[j]))
                        both.sort()
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        if scheme.den * shared >= scheme.num * (len(both) - shared):
                            links.append((int(block.component[i]), int(block.component[j])))
                            forest.join(int(a), int(b))
                            root[root == a] = b
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return emit


def jaccard_components(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 5,
    threshold: tuple[int, int] = (4, 5),
) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row of ``docs``.

    Texts are lower-cased (A-Z); the set of a text is its distinct ``size``-word shingles, with fewer
    words the whole sequence as one. Rows link when ``den * shared >= num * all`` of their sets, for
    ``threshold = (num, den)``; ``component_id`` is the smallest id reachable by links, the row's own included.

    Null or wordless texts have no shingles and link with nothing: their component is their own id. Rows with
    equal texts or equal ids are rows of their own. A null id never is a component's name while another
    id is there. An empty table gives no rows; other columns are not looked at. A text is held whole by one task.
    """
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    for seed in range(8):
        scheme = Scheme(*threshold, size, seed)
        done = _components(docs, scheme)
        if done is not None:
            return done.select(F.col("id").alias(id_column), "n_shingles", "component_id")
    raise RuntimeError("fingerprints of different sets collide under every seed")


def _components(docs: DataFrame, scheme: Scheme) -> DataFrame | None:
    spark = docs.sparkSession
    rows = _signature_rows(docs, scheme, "text", None)
    shared = written(
        rows.groupBy("sig")
        .agg(F.min("node").alias("centre"), F.max("node").alias("last"))
        .filter(F.col("centre") < F.col("last"))
        .select("sig", "centre"),
        "signatures",
    )
    release_shuffles(spark)
    again = _signature_rows(docs, scheme, "text", bitmap(shared, "sig"))
    members = written(again.join(shared, "sig").distinct(), "members")
    release_shuffles(spark)
    every = written(_membership(docs, scheme, "id", "text", bitmap(members.select("node").distinct(), "node")), "sets")
    filled = every.filter(F.col("node").isNotNull())
    clash = filled.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).filter("x != y")
    if not clash.isEmpty():
        return None
    # one row per node: the tasks that met a copy of it wrote the same sketch and set
    kept = filled.filter(F.col("sketch").isNotNull())
    light = written(compact(kept.select("node", "n", "sketch").dropDuplicates(["node"])), "nodes")
    heavy = kept.select("node", "elements")

    star = members.filter(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    with wide_rows(spark):
        likely = written(compact(_likely(star, light, scheme)), "likely")
        links = written(compact(_confirmed(likely, _needed(heavy, likely), scheme)), "stars")
    first = written(compact(components(links, "a", "b")), "components")

    placed = written(
        members.select("sig", "node")
        .join(light.select("node", "n"), "node")
        .join(first, "node", "left")
        .select("sig", "node", "n", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    still = (
        placed.groupBy("sig")
        .agg(
            F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("held"), F.sum("n").alias("elements"),
            F.bit_xor(F.xxhash64("node")).alias("set"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("again"),
        )
        .filter("x != y")
        # signatures of the same nodes pose the same pairs: one of them is enough
        .groupBy("held", "elements", "set", "again").agg(F.min("sig").alias("sig"))
        .select("sig", "held", F.ceil(F.greatest(F.col("held") / BLOCK, F.col("elements") / BLOCK_ELEMENTS)).cast("long").alias("blocks"))
    )
    open_rows = written(placed.join(still, "sig"), "open")
    for done in (shared, members, first, placed):
        discard(done)
    release_shuffles(spark)
    few = open_rows.filter(F.col("held") <= FEW).select("sig", "node", "component", "n")
    few = few.repartition(tasks(spark), "sig").sortWithinPartitions("sig", "node")
    pairs = written(compact(few.mapInArrow(_few_pairs(scheme), "a long, b long").distinct()), "pairs")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    bucket = ["sig", "lo", "hi"]
    facing = (
        open_rows.filter(F.col("held") > FEW)
        .join(light.select("node", "sketch"), "node")
        .select("sig", "node", "component", "n", "sketch", block.alias("block"), other)
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .select("sig", "lo", "hi", "node", "component", "n", "block", "sketch")
        .repartition(tasks(spark), *bucket)
        .sortWithinPartitions(*bucket, "node")
    )
    with wide_rows(spark):
        likely = written(compact(_likely(pairs, light, scheme)), "likely")
        more = written(compact(_confirmed(likely, _needed(heavy, likely), scheme)), "more")
        rest = written(facing.mapInArrow(_near_rows(scheme), facing.schema), "near")
        facing = (
            rest.join(_needed(heavy, rest.select(F.col("node").alias("a"), F.col("node").alias("b"))), "node")
            .select(*rest.columns, "elements")
            .repartition(tasks(spark), *bucket)
            .sortWithinPartitions(*bucket, "node")
        )
        # links between components: their names are nodes too
        most = written(facing.mapInArrow(_linked_rows(scheme), "a long, b long"), "most")
    last = components(links.unionAll(more).unionAll(most), "a", "b")

    # the smallest id of each node, then of each component
    named = (
        filled.groupBy("node").agg(F.min("id").alias("least"))
        .join(last, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = written(compact(named.join(names, "component").select("node", "component_id")), "labels")
    return (
        every.select("id", "node", F.col("n").alias("n_shingles"))
        .join(labelled, "node", "left")
        .select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def _needed(heavy: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the nodes in ``pairs``, one row each; sets that no pair needs are not shuffled."""
    wanted = bitmap(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))), "node")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.has(batch.column("node").to_numpy())))

    return heavy.mapInArrow(emit, "node long, elements binary").dropDuplicates(["node"])


def keep_one(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one row of each group of linked rows stays.

    Of rows that share the id of the component (repeated rows), all stay: they are told apart by nothing.
    Rows with a null id stay if they are alone.
    """
    with wide_rows(docs.sparkSession, 1000):  # workers hold the models of the stage before, and few texts at a time
        found = jaccard_components(docs, id_column, **options)
    keep = found.filter(F.col(id_column).eqNullSafe(F.col("component_id"))).select(F.col(id_column).alias("_kept")).distinct()
    return docs.join(keep, docs[id_column].eqNullSafe(keep["_kept"]), "left_semi")


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, threshold=(85, 100))
