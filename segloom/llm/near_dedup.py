"""MinHash near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. In each of several independent trees a node's documents are parted by the minwise
token of one or two coordinates that the node chooses; nodes of few documents are compared pair by pair, larger ones branch
again. Sketches discard pairs that are far apart, and links are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import BROADCAST_ROWS, HOT_ROWS, connected_components, join_counted, stored
from segloom.llm.words import SPACES, Lexer, mix, release, runs

#: Words of a shingle; similarity from which documents are linked, in hundredths; trees; minwise tokens of a document.
SHINGLE, PERCENT, TREES, TOKENS = 5, 85, 12, 128
#: Documents of a node that is compared exhaustively; chance of a pair at the threshold below which no tree branches further.
NODE, RECALL = 2048, 0.99
#: Shingles of a group that one row holds; larger groups are compared in blocks.
GROUP_SHINGLES = 4_000_000
#: Documents of a large node with which all others of it are compared before it branches again.
PIVOTS = 4
_MULTIPLY = mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix(_MULTIPLY)


def _distinct(code: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, sorted, and their offsets."""
    hashes, offsets = runs(code, first, k)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    begins = offsets[:-1]
    keep[begins[begins < offsets[1:]]] = True
    sums = np.concatenate([[0], np.cumsum(keep)])
    return hashes[keep], sums[offsets]


def minwise(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each non-empty set a row of TOKENS 32-bit minwise tokens."""
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    out = np.empty((len(begins), TOKENS), np.uint32)
    if len(begins):
        scratch = np.empty_like(sets)
        with np.errstate(over="ignore"):
            for j in range(TOKENS):
                np.multiply(sets, _MULTIPLY[j], out=scratch)
                scratch += _ADD[j]
                out[:, j] = np.minimum.reduceat(scratch, begins) >> np.uint64(32)
    return out


def _marks(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    lexer = Lexer(SPACES)
    for batch in batches:
        for block in lexer.blocks(batch.column(1)):
            sets, offsets = _distinct(block.code, block.first, shingle)
            count = np.diff(offsets)
            full = np.flatnonzero(count)
            sums = np.zeros((len(count), 2), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    sums[full, 0] = np.add.reduceat(mix(sets), offsets[:-1][full])
                    sums[full, 1] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][full])
            tokens = minwise(sets, offsets)
            raw = pa.py_buffer(np.ascontiguousarray(tokens))
            ends = np.concatenate([[0], np.cumsum(count > 0)]).astype(np.int32) * TOKENS * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.rows.start, len(count)),
                    pa.array(count),
                    pa.array(sums[:, 0].view(np.int64)),
                    pa.array(sums[:, 1].view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), raw]),
                ],
                names=["id", "n", "s0", "s1", "tokens"],
            )


def recall_at(depth: int, percent: int, trees: int) -> float:
    """The chance that a pair at the threshold is still together in a node of any tree after so many steps.

    A step keeps a pair together by its first coordinate with the share of tokens in which the pair agrees, and by a second one,
    which ``_children`` takes (but at the roots) so often that a pair has one common child on average. That share is the
    similarity on average only: it is drawn once for all trees, and the chance is the mean over its draws."""
    s, q, total = percent / 100, 100 / percent - 1, 0.0
    for agree in range(TOKENS + 1):
        p, alive = agree / TOKENS, 1.0
        for _ in range(depth - 1):
            alive = 1 - (1 - p * alive) * (1 - q * p * alive)
        total += math.comb(TOKENS, agree) * s**agree * (1 - s) ** (TOKENS - agree) * (1 - (1 - p * alive) ** trees)
    return total


def deepest(percent: int, trees: int, recall: float = RECALL) -> int:
    """The steps that a tree may take; one at least."""
    depth = 1
    while depth < 64 and recall_at(depth + 1, percent, trees) >= recall:
        depth += 1
    return depth


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Two bits of each token, packed: 256 bits a document."""
    bits = np.stack([tokens & 1, (tokens >> 1) & 1], 2).astype(np.uint8)
    return np.packbits(bits.reshape(len(tokens), -1), axis=1)


def _children(node: np.ndarray, rows: np.ndarray, tokens: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes for documents: by the minwise token of the coordinate that the node chooses, and with
    probability ``second`` (of the node) by that of another as well."""
    out_rows, out_node = [], []
    with np.errstate(over="ignore"):
        draw = mix(node + np.uint64(0x632BE59BD9B4E019))
        for turn in (0, 1):
            take = np.ones(len(node), bool) if turn == 0 else (draw >> np.uint64(11)).astype(np.float64) / 2.0**53 < second
            coordinate = (mix(draw[take] + np.uint64(turn)) % np.uint64(TOKENS)).astype(np.int64)
            token = tokens[rows[take], coordinate].astype(np.uint64)
            out_node.append(mix(node[take] * np.uint64(0x9E3779B97F4A7C15) + mix(token + (coordinate.astype(np.uint64) << np.uint64(40)) + np.uint64(1))))
            out_rows.append(rows[take])
    return np.concatenate(out_node), np.concatenate(out_rows)


def _fresh(batches: Iterator[pa.RecordBatch], trees: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(node, id, n, depth, sketch) of the nodes to which documents go: from the roots of all trees, or ``steps`` steps down from
    a node that is still too large. A second coordinate is chosen so often that a linked pair shares a child on average."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
        rows = np.arange(batch.num_rows)
        if "node" not in batch.schema.names:
            at = np.repeat(rows, trees)
            child, at = _children(mix(np.tile(np.arange(1, trees + 1, dtype=np.uint64), batch.num_rows)), at, tokens, 0.0)
            depth = np.ones(batch.num_rows, np.int32)
        else:
            steps = np.asarray(batch.column("steps"))
            depth = np.asarray(batch.column("depth")) + steps
            done, node, at = [], np.asarray(batch.column("node")).view(np.uint64), rows
            for k in range(1, int(steps.max()) + 1):
                node, at = _children(node, at, tokens, 100 / percent - 1)
                here = steps[at] == k
                done.append((node[here], at[here]))
                node, at = node[~here], at[~here]
            child, at = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        where = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(child.view(np.int64)), *(batch.column(c).take(where) for c in ("id", "n", "part") if c in batch.schema.names), pa.array(depth.astype(np.int32)[at]), pa.array([x.tobytes() for x in _sketch(tokens)], pa.binary()).take(where)],
            names=["node", *(c for c in ("id", "n", "part") if c in batch.schema.names), "depth", "sketch"],
        )


def _allowed(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and sketches (rows of 64-bit words) allow the similarity: as many tokens agree as then do on average, less
    4.5 deviations."""
    s = percent / 100
    agree = s + (1 - s) / 4
    least = TOKENS * agree - 4.5 * math.sqrt(TOKENS * agree * (1 - agree))
    x = a ^ b
    same = TOKENS - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
    return (same >= least) & (100 * np.minimum(a_size, b_size) >= percent * np.maximum(a_size, b_size))


def _near(sketches: np.ndarray, sizes: np.ndarray, percent: int, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes and sketches allow the similarity, but those of one part (what links already hold together)."""
    words = sketches.view(np.uint64).reshape(len(sketches), -1)
    left, right = [], []
    for i in range(len(words) - 1):
        good = _allowed(words[i + 1 :], words[i], sizes[i + 1 :], sizes[i], percent)
        if parts is not None:
            good &= parts[i + 1 :] != parts[i]
        good = np.flatnonzero(good)
        left.append(np.full(len(good), i))
        right.append(good + i + 1)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _clusters(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each small node the groups of documents that sketches hold together, as sorted lists of ids."""
    for batch in batches:
        every, size, raw = (batch.column(c).flatten() for c in ("members", "sizes", "sketches"))
        every, size = every.to_numpy(), size.to_numpy()
        part = batch.column("parts").flatten().to_numpy() if "parts" in batch.schema.names else None
        begin = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset] if len(raw) else 0
        packed = np.frombuffer(raw.buffers()[2], np.uint8)[begin : begin + len(raw) * TOKENS // 4].reshape(len(raw), -1) if len(raw) else np.zeros((0, TOKENS // 4), np.uint8)
        cuts = np.concatenate([[0], np.cumsum(batch.column("members").value_lengths().to_numpy())])
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            order = np.argsort(every[a:b], kind="stable")
            ids, sizes, sketch = every[a:b][order], size[a:b][order], packed[a:b][order]
            left, right = _near(np.ascontiguousarray(sketch), sizes, percent, None if part is None else part[a:b][order])
            if not len(left):
                continue
            forest = _Forest(len(ids))
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                forest.join(i, j)
            roots = np.array([forest.root(i) for i in range(len(ids))])
            used = np.unique(np.concatenate([left, right]))
            for r in np.unique(roots[used]):
                mine = np.flatnonzero(roots == r)
                block = np.cumsum(sizes[mine]) // (GROUP_SHINGLES // 2)
                parts = [mine[block == k] for k in np.unique(block)]
                pairs = [mine] if len(parts) < 3 else [np.concatenate([x, y]) for k, x in enumerate(parts) for y in parts[k + 1 :]]
                out += [ids[np.sort(x)].tolist() for x in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["members"])
        release()


def _beside(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (pivot, pivot_n, pivot_sketch, id, n, sketch) those that sketches hold for links: (pivot, pivot_n, id)."""
    for batch in batches:
        wide = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        near = _allowed(wide("sketch"), wide("pivot_sketch"), np.asarray(batch.column("n")), np.asarray(batch.column("pivot_n")), percent) if batch.num_rows else []
        yield batch.select(["pivot", "pivot_n", "id"]).filter(pa.array(near, pa.bool_()))


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """What confirmed links hold together in each group, as a star around the smallest id. Full sets become rows of bits over
    the shingles that two members share, and all pairs are intersected by counting bits."""
    for batch in batches:
        a_out, b_out = [], []
        for ids, sets in zip(batch.column("ids").to_pylist(), batch.column("sets"), strict=True):
            arrays = [np.frombuffer(x.as_buffer(), np.uint64) for x in sets.values]
            ids = np.array(ids)
            order = np.argsort(ids, kind="stable")
            ids, arrays = ids[order], [arrays[i] for i in order]
            sizes = np.array([len(x) for x in arrays])
            joined = np.concatenate(arrays)
            owner = np.repeat(np.arange(len(arrays)), sizes)
            by = np.argsort(joined, kind="stable")
            token, owner = joined[by], owner[by]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            column = np.cumsum(new) - 1
            shared = np.bincount(column) > 1
            column_at = (np.cumsum(shared) - 1)[column]
            keep = shared[column]
            owner, column = owner[keep], column_at[keep]
            wide = (int(shared.sum()) + 63) // 64
            forest = _Forest(len(ids))
            step = max(1, (64 << 20) // max(1, len(ids) * 8))  # columns of bits at a time
            inter = np.zeros((len(ids), len(ids)), np.int32)
            for at in range(0, max(wide, 1), step):
                here = (column >= at * 64) & (column < (at + step) * 64)
                bits = np.zeros((len(ids), min(step, max(wide - at, 1))), np.uint64)
                c = column[here] - at * 64
                np.bitwise_or.at(bits, (owner[here], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
                for i in range(len(ids) - 1):
                    inter[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1).astype(np.int32)
            union = sizes[:, None] + sizes[None, :] - inter
            left, right = np.nonzero(np.triu(100 * inter.astype(np.int64) >= percent * union, 1))
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                forest.join(i, j)
            roots = np.array([forest.root(i) for i in range(len(ids))])  # the smallest id of each joined part
            linked = np.flatnonzero(roots != np.arange(len(ids)))
            a_out += ids[linked].tolist()
            b_out += ids[roots[linked]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
        release()


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    lexer = Lexer(SPACES)
    for batch in batches:
        for block in lexer.blocks(batch.column(1)):
            sets, offsets = _distinct(block.code, block.first, shingle)
            ends = pa.py_buffer((offsets * 8).astype(np.int32))
            raw = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, ends, pa.py_buffer(sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(offsets) - 1), raw], names=["id", "shingles"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, node: int = NODE, depth: int | None = None, most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Texts are lower-cased (A-Z), cut at white space and taken as sets of ``shingle``-word runs (a shorter text is one run).
    Two documents are linked if 100 * |A and B| >= ``percent`` * |A or B|. Equal sets form a class by a 128-bit sum of
    their hashes, and only the class's smallest id takes part in the join, so copies are counted, not paired.

    A tree's nodes part documents by a minwise token. Nodes of up to ``node`` documents are compared exhaustively, by sketches
    first; of what these hold together the distinct groups are compared on full sets. A larger node branches again, but for
    near copies that would not part: those beside one of a few pivots are linked with it first, and a node that links then
    hold together but for ``node`` / 2 documents is done when these are compared with all. A pair at the threshold is found
    with the probability of ``recall_at``; no node branches below ``depth`` steps, by default the last at which that is 0.99
    (12 trees at 85: 10 steps, at 80: 7). Nodes that are still larger are compared in blocks of half a node, each pair of blocks
    as a node of its own, but for two blocks that links hold together already: nothing is dropped.

    Counts of copies are joined back with the texts of over ``hot`` copies kept apart (``join_counted``).

    Null and empty texts have no shingles and are linked with nothing. Rows with a null id come back with a null component,
    kept. Repeated ids share their links. An empty table gives no rows. Ids must be integers; other columns are not read.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = stored(text.mapInArrow(lambda it: _marks(it, shingle), "id long, n long, s0 long, s1 long, tokens binary"), "marks")
    some = marks.where("id IS NOT NULL AND n > 0")
    classes = stored(some.groupBy("n", "s0", "s1").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "classes")
    counted = classes.select(F.col("n").alias("size"), "s0", "s1", "rep", F.col("rows").alias("n"))
    copies = join_counted(some.select("id", F.col("n").alias("size"), "s0", "s1"), counted, ["size", "s0", "s1"], "id", most, hot)
    copies = stored(copies.where("rep IS NOT NULL").select("id", "rep"), "copies")
    others = copies.where("id <> rep").distinct()
    repeated = copies.where("id = rep").count() > classes.count()  # rows of one id and text
    heads = some.select("id", "n", "tokens").join(_small(others.select("id"), copies.count()), "id", "left_anti")
    heads = heads.dropDuplicates(["id", "n", "tokens"]) if repeated else heads

    def linked(members: DataFrame) -> DataFrame:
        """Stars of the confirmed links of groups (g, id): the full sets of a group come together and are compared."""
        members = stored(members, "members")
        rows = members.count()
        wanted = stored(_packed(members.select("id").distinct(), rows), "wanted")
        texts = text.join(_small(wanted, wanted.count()), "id", "left_semi")
        sets = texts.mapInArrow(lambda it: _sets(it, shingle), "id long, shingles binary")
        sets = sets.dropDuplicates(["id"]) if repeated else sets
        full = members.join(sets, "id").groupBy("g").agg(F.collect_list("id").alias("ids"), F.collect_list("shingles").alias("sets"))
        return stored(_packed(full.select("ids", "sets"), 20 * rows).mapInArrow(lambda it: _links(it, percent), "a long, b long"), "links")

    def compared(nodes: DataFrame, rows: int) -> DataFrame:
        """The groups that sketches hold together in nodes of bounded size (node, id, n, sketch, and part if any)."""
        lists = {"members": "id", "sizes": "n", "sketches": "sketch"} | ({"parts": "part"} if "part" in nodes.columns else {})
        nodes = nodes.groupBy("node").agg(*[F.collect_list(c).alias(x) for x, c in lists.items()]).where(F.size("members") > 1).drop("node")
        return stored(_packed(nodes, rows).mapInArrow(lambda it: _clusters(it, percent), "members array<long>"), "groups")

    groups, hub_links, known = [], [], None
    limit = deepest(percent, trees) if depth is None else depth
    open_, rows = heads, marks.count() * trees
    while open_ is not None:
        first = open_ is heads
        kids = open_.mapInArrow(lambda it: _fresh(it, trees, percent), "node long, id long, n long, " + ("part long, " if known is not None else "") + "depth int, sketch binary")
        if not first:
            kids = stored(_packed(kids, rows), "children")
            rows = kids.count()
        large = stored(kids.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > node), "large_nodes")
        many, total = large.agg(F.count("*"), F.sum("size")).first()
        large = _small(large, many)
        groups.append(compared(kids.join(large.select("node"), "node", "left_anti") if many else kids, rows))
        open_ = None
        if not many:
            break
        rows, wide = total, stored(_packed(kids.join(large, "node"), total), "wide")
        hubs = _hubs(wide, node, many, percent)
        if hubs is not None:
            hub_links.append(linked(hubs))
            known = stored(connected_components(reduce(DataFrame.union, hub_links)), "known")
            known = _small(known.select(F.col("node").alias("id"), "component"), known.count())
        if known is not None:
            wide = wide.drop("part").join(known, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
            held = wide.groupBy("node", "part").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("part", "n").alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
            held = stored(held, "held_nodes")
            wide = wide.join(_small(held, many), "node")
        else:
            wide = wide.withColumns({"part": F.col("id"), "main": F.lit(None).cast("long"), "rest": F.col("size")})
        done = F.col("rest") <= node // 2
        exact = stored(_blocks(wide.where((done | (F.col("depth") >= limit)) & (F.col("rest") > 0)), node), "blocks")
        groups.append(compared(exact, exact.count()))
        wide = stored(wide.where(~done & (F.col("depth") < limit)), "wide")
        rows = wide.count()
        if not rows:
            break
        # a step halves a node of dissimilar documents, and shrinks one of similar documents less
        steps = F.least(F.greatest(F.floor(F.log2(F.col("size") / node)), F.lit(1)), limit - F.col("depth")).cast("int")
        branch = wide.select("node", "id", "depth", steps.alias("steps"), *(["part"] if known is not None else []))
        open_ = stored(_packed(heads.join(_small(branch, rows), "id"), rows), "open")
    # equal groups of several trees are compared once; two groups with one hash would be compared together
    members = reduce(DataFrame.union, groups).select(F.xxhash64("members").alias("g"), F.explode("members").alias("id")).distinct()
    links = reduce(DataFrame.union, [linked(members), *hub_links])
    parts = stored(connected_components(links), "components") if not links.isEmpty() else spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    head = marks.select("id", F.col("n").alias("n_shingles")).join(others, "id", "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("node"))
    weight = classes.groupBy(F.col("rep").alias("node")).agg(F.sum("rows").alias("n"))
    parts = stored(parts.join(weight, "node", "left").select("node", "component", F.coalesce("n", F.lit(1)).alias("n")), "parts")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    out = join_counted(head, parts, ["node"], "id", most, hot).withColumn("component_id", component)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast if its rows, already counted, are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _packed(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """So many partitions at most that each has ``each`` of about ``rows`` rows: what little is left isn't spread thin."""
    return df.coalesce(max(8, rows // each))


def _hubs(wide: DataFrame, node: int, nodes: int, percent: int) -> DataFrame | None:
    """Groups (g, id) around documents to which sketches hold more than ``node`` others of a large node, if any: a few pivots
    of each node, drawn by a hash from those without a part of their own, and the documents beside them in blocks, each with
    its pivot. So a large group of near copies is held together by as many comparisons as it has documents, times a block."""
    alone = wide.where("part = id") if "part" in wide.columns else wide
    drawn = alone.groupBy("node").agg(F.array(*[F.min_by(F.struct("id", "n", "sketch"), F.xxhash64(F.lit(k), "id")) for k in range(PIVOTS)]).alias("p"))
    drawn = drawn.select("node", F.explode(F.array_distinct("p")).alias("p")).select("node", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.sketch").alias("pivot_sketch"))
    drawn = _small(stored(drawn, "pivots"), PIVOTS * nodes)
    near = wide.join(drawn, "node").select("pivot", "pivot_n", "pivot_sketch", "id", "n", "sketch").mapInArrow(lambda it: _beside(it, percent), "pivot long, pivot_n long, id long")
    near = stored(near.where("id <> pivot").distinct(), "beside")
    hot = stored(near.groupBy("pivot", "pivot_n").agg(F.count("*").alias("size")).where(F.col("size") > node), "hubs")
    many = hot.count()
    if not many:
        return None
    in_block = F.greatest(F.lit(1), F.least(F.lit(node // 2), F.expr(f"{GROUP_SHINGLES // 2} div pivot_n")))
    hot = hot.select("pivot", F.ceil(F.col("size") / in_block).alias("blocks"))
    dealt = near.join(_small(hot, many), "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("id"), "blocks")).alias("g"), "id", "pivot")
    return dealt.select("g", "id").union(dealt.select("g", "pivot").distinct())


def _blocks(wide: DataFrame, node: int) -> DataFrame:
    """Nodes (node, size, main, rest, id, n, part, sketch) as nodes of two blocks: the ``rest``, what is not in the part ``main``, is
    dealt to blocks of half a node, and so is the main part; each block of the rest meets every block."""
    half = node // 2
    block = lambda rows: F.ceil(rows / half).cast("long")
    inside, others = block(F.col("size") - F.col("rest")), block(F.col("rest"))
    main = F.coalesce(F.col("part") == F.col("main"), F.lit(False))
    dealt = wide.withColumn("x", F.when(main, F.pmod(F.xxhash64("id"), F.greatest(inside, F.lit(1)))).otherwise(inside + F.pmod(F.xxhash64("id"), F.greatest(others, F.lit(1)))))
    met = F.sequence(F.when(main, inside).otherwise(F.lit(0).cast("long")), inside + others - 1)
    both = dealt.withColumn("y", F.explode(met))
    return both.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("node"), "id", "n", "part", "sketch")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id, with all its columns."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(id_col).distinct()
    gone = stored(gone, "near_copies")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, id_col, "left_anti")
