"""Jaccard self-join of documents on word shingles, as connected components.

1. One pass over the texts gives every document the number of its shingles, a class
   (documents with the same shingle set are one class), ``KEYS`` min-hashes, a bitmap
   of its shingles, and the shingles that an Arrow batch holds more than once; from
   these the frequent shingles of the corpus follow.
2. Classes that share a min-hash form groups.  A group is cut into blocks of at most
   ``BLOCK_SETS`` classes, each with the group's first class beside its own, and each
   block is joined exactly by a :mod:`signature tree <.signature_tree>`.  A second
   round of blocks gathers the classes that are still apart around the class, among
   those that share a shingle, whose shingles are shared most: copies that are alike
   through their original alone meet it there.
3. Whatever is still apart is joined by trees over prefix lists: with the frequent
   shingles last in the order, classes that are similar share a shingle of their
   prefixes, so the classes of each such shingle are one list, and equal lists are
   one.  A tree of bitmaps and sizes walks every list; the pairs it lets through become
   clusters within the task, and the classes of a cluster meet, by two sides of
   ``BLOCK_SETS``, in blocks that a tree over the whole sets decides.

Pairs that are already connected are left out everywhere, and no step emits pairs: a
block gives one edge for a class at most, and a cluster of ``m`` classes costs
``m * m / BLOCK_SETS`` rows.  The order of the shingles, and so the frequent list (at most
``FREQUENT_MOST``, of all documents), has no part in the result: any order gives the
same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .runtime import dealt as dealt_table
from .runtime import partitions, released, ship_by_value, swept, written
from .signature_tree import BitmapTree, SignatureTree, bitmap, width_of

SHINGLE, PERCENT = 5, 75
KEYS, BLOCK_SETS = 4, 200
LIST_BLOCK, SHORT_LIST = 2000, 64
#: Tokens that a kernel holds before it sends what it has gathered.
HELD = 1 << 20
FREQUENT, FREQUENT_MOST = 16, 1 << 20
BROADCAST_ROWS = 1 << 20
_SEEDS = np.array([0, 0x9E6C63D0676A9A99, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_DOCS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), *((f"k{i}", pa.int64()) for i in range(KEYS)), ("bits", pa.binary())])
_DOCS_DDL = "kind byte, a long, n long, cls long, " + ", ".join(f"k{i} long" for i in range(KEYS)) + ", bits binary"


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by document, ascending, and the ranges of the documents.

    A text of fewer than ``SHINGLE`` words has its whole word sequence as one shingle.
    """
    s, e, doff = T.words(raw, off, T.NOT_SPACE)
    h = T.word_hashes(raw, s, e, T.BYTE_CODE[T.LOWER])
    n = np.diff(doff)
    g = T.gram_hashes(h, SHINGLE)
    ok = T.inside(doff, SHINGLE, len(g))
    doc = np.repeat(np.arange(len(n)), n)
    at, tokens = doc[: len(g)][ok], g[ok]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        whole = np.array([T.gram_hashes(h[doff[d] : doff[d + 1]], int(n[d]))[0] for d in few], np.uint64)
        at, tokens = np.concatenate([at, few]), np.concatenate([tokens, T.mix(whole + n[few].astype(np.uint64))])
    order = np.lexsort((tokens, at))
    at, tokens = at[order], tokens[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (tokens[1:] != tokens[:-1])
    return tokens[new], np.searchsorted(at[new], np.arange(len(n) + 1))


def classes_of(tokens: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """A name for each non-empty set: hashes of the sums of two hashes of its tokens."""
    full = np.diff(soff) > 0
    out = np.zeros(len(full), np.uint64)
    if full.any():
        one = np.add.reduceat(T.mix(tokens), soff[:-1][full])
        two = np.add.reduceat(T.mix(tokens ^ np.uint64(0xA5A5A5A55A5A5A5A)), soff[:-1][full])
        out[full] = T.mix(one) ^ T.mix(two + np.diff(soff)[full].astype(np.uint64))
    return out


def _own_bitmap(tokens: np.ndarray) -> bytes:
    return bitmap(tokens, width_of(len(tokens))).tobytes()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: list[np.ndarray] = []
        known: set[int] = set()

        def repeated() -> Iterator[pa.RecordBatch]:
            if not seen:
                return
            token, count = np.unique(np.concatenate(seen), return_counts=True)
            seen.clear()
            token, count = token[count > 1], count[count > 1]
            zero = pa.array(np.zeros(len(token), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int8)), pa.array(token.view(np.int64)), pa.array(count), zero, *[zero] * KEYS, pa.nulls(len(token), pa.binary())], schema=_DOCS)

        for i, j, raw, off in T.rows(batch.column(1)):
            tokens, soff = shingle_sets(raw, off)
            n = np.diff(soff)
            cls = classes_of(tokens, soff)
            keys = np.zeros((KEYS, j - i), np.uint64)
            full = n > 0
            for k in range(KEYS):
                if full.any():
                    keys[k, full] = np.minimum.reduceat(T.mix(tokens ^ _SEEDS[k]) if k else tokens, soff[:-1][full])
            for d in np.flatnonzero(full).tolist():
                if (c := int(cls[d])) not in known:
                    known.add(c)
                    seen.append(tokens[soff[d] : soff[d + 1]])
            body = pa.array([_own_bitmap(tokens[x:y]) for x, y in zip(soff[:-1].tolist(), soff[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int8)), batch.column(0)[i:j], pa.array(n), pa.array(cls.view(np.int64)), *(pa.array(k.view(np.int64)) for k in keys), body], schema=_DOCS)
            if sum(map(len, seen)) >= HELD:
                yield from repeated()
        yield from repeated()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (places, text): (key, salt, cls, comp, tokens) for each of the places (key, salt, cls, comp) that names the class of the text."""
    for batch in batches:
        for i, j, raw, off in T.rows(batch.column(1)):
            tokens, soff = shingle_sets(raw, off)
            own, places = classes_of(tokens, soff).view(np.int64), batch.column(0).slice(i, j - i)
            doc = np.repeat(np.arange(j - i), places.value_lengths().to_numpy())
            key, salt, cls, comp = (x.to_numpy() for x in places.flatten().flatten())
            here = np.flatnonzero(cls == own[doc])  # an id that is repeated can have other texts
            ends = np.concatenate([[0], np.cumsum(np.diff(soff)[doc[here]])])
            for x, y in T.chunks(ends, HELD):
                at = here[x:y]
                held = np.concatenate([tokens[soff[d] : soff[d + 1]] for d in doc[at].tolist()])
                body = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(((ends[x : y + 1] - ends[x]) * 8).astype(np.int32).tobytes()), pa.py_buffer(held.tobytes())])
                yield pa.RecordBatch.from_arrays([*(pa.array(z[at]) for z in (key, salt, cls, comp)), body], names=["key", "salt", "cls", "comp", "tokens"])


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, cls, comp, tokens) come sorted by block; its links as edges to the first of each component.

    Classes of one ``comp`` are connected already.
    """

    def links(cls: list[int], comp: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        root = SignatureTree(sets, PERCENT, comp).components()
        return [cls[i] for i, r in enumerate(root) if r != i], [cls[r] for i, r in enumerate(root) if r != i]

    block, cls, comp, sets = None, [], [], []
    for batch in batches:
        a, b = [], []
        for key, salt, c, known, tokens in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (key, salt) != block:
                for to, x in zip((a, b), links(cls, comp, sets) if len(cls) > 1 else ([], []), strict=True):
                    to += x
                block, cls, comp, sets = (key, salt), [], [], []
            if not cls or cls[-1] != c:
                cls.append(c)
                comp.append(known)
                sets.append(np.frombuffer(tokens, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    if len(cls) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(cls, comp, sets)], names=["a", "b"])


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Similar sets share one of so many first tokens."""
    return n - (PERCENT * n + 99) // 100 + 1


def _postings(frequent, parts: int):
    """Prefix tokens with their class, packed by part of the token range."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(frequent.value, np.uint64)
        def packed(token: list[np.ndarray], owner: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not token:
                return
            t, c = np.concatenate(token), np.concatenate(owner)
            token.clear()
            owner.clear()
            part = (t % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            t, c, cut = t[order], c[order], np.searchsorted(part[order], np.arange(parts + 1))
            rows = [p for p in range(parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([t[cut[p] : cut[p + 1]].tobytes() for p in rows], pa.binary()), pa.array([c[cut[p] : cut[p + 1]].tobytes() for p in rows], pa.binary())], names=["part", "tokens", "classes"])

        for batch in batches:
            token, owner, known = [], [], set()
            for _, _, raw, off in T.rows(batch.column(0)):
                tokens, soff = shingle_sets(raw, off)
                n, cls = np.diff(soff), classes_of(tokens, soff)
                doc = np.repeat(np.arange(len(n)), n)
                late = np.zeros(len(tokens), bool)
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                order = np.lexsort((late, doc))  # tokens are ascending already, and the sort is stable
                doc, tokens = doc[order], tokens[order]
                fresh = np.zeros(len(n), bool)
                for d in np.flatnonzero(n > 0).tolist():
                    if (c := int(cls[d])) not in known:
                        known.add(c)
                        fresh[d] = True
                keep = fresh[doc] & (np.arange(len(doc)) - soff[doc] < prefix_length(n)[doc])
                token.append(tokens[keep])
                owner.append(cls[doc[keep]])
                if sum(map(len, token)) >= HELD:
                    yield from packed(token, owner)
            yield from packed(token, owner)

    return kernel


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the packed postings of each part: those whose token has more than one class.  Rows come sorted by part."""

    def found(tokens: list[bytes], classes: list[bytes]) -> pa.RecordBatch:
        t, c = np.frombuffer(b"".join(tokens), np.uint64), np.frombuffer(b"".join(classes), np.uint64)
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c = t[new], c[new]
        many = np.zeros(len(t), bool)
        same = t[1:] == t[:-1]
        many[1:] |= same
        many[:-1] |= same
        return pa.RecordBatch.from_arrays([pa.array(t[many].view(np.int64)), pa.array(c[many].view(np.int64))], names=["token", "cls"])

    part, tokens, classes = None, [], []
    for batch in batches:
        for p, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if p != part:
                if tokens:
                    yield found(tokens, classes)
                part, tokens, classes = p, [], []
            tokens.append(t)
            classes.append(c)
    if tokens:
        yield found(tokens, classes)


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Tables of whole groups: rows come sorted by the first columns; with the bounds of the groups."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        if not len(now):
            continue
        new = np.zeros(len(now), bool)
        new[0] = True
        for k in range(keys):
            key = now.column(k).to_numpy()
            new[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        if len(first) > 1:
            yield first, now.slice(0, first[-1]).combine_chunks()
        rest = now.slice(first[-1])
    if rest is not None and len(rest):
        yield np.array([0, len(rest)]), rest.combine_chunks()


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, cls, comp, score) come sorted by token: (centre, cls, c) for classes not connected to the centre.

    The centre of a token is its class of the highest score; ``c`` counts the tokens of
    this partition that give the pair.
    """
    for bound, rows in _groups(batches):
        cls, comp, score = (rows.column(k).to_numpy() for k in (1, 2, 3))
        size = np.diff(bound)
        group = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((cls, -score, group))
        top = order[bound[:-1]]
        centre = np.repeat(cls[top], size)
        away = comp != np.repeat(comp[top], size)
        if away.any():
            pairs = np.stack([centre[away], cls[away]], 1)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)]))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[first, 0]), pa.array(pairs[first, 1]), pa.array(np.diff(np.append(first, len(pairs))))], names=["centre", "cls", "c"])


def _list_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (deal, list, lo, hi, side, cls, comp, n, bits) come sorted by list block: edges (a, b) that join what may be similar.

    A list block joins the two sides ``lo`` and ``hi`` of a list, or a side with itself, by a
    tree.  Sets that can be similar differ by a factor of two in the width of their
    bitmaps at most: a tree holds the sets of one width and those of the next, folded.
    The pairs that a tree lets through are joined to clusters here and never sent: a class
    has one edge at most, to the first of its cluster.
    """
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    def block(side: np.ndarray, cls: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], crossed: bool) -> None:
        width = np.array([len(x) for x in bits])
        for w in np.unique(width).tolist():
            own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            wider = wider[PERCENT * n[wider] <= 100 * n[own].max()]
            rows = np.concatenate([own, wider])
            if len(rows) < 2 or comp[rows].min() == comp[rows].max():
                continue
            halves = np.frombuffer(b"".join(bits[i] for i in wider.tolist()), np.uint64).reshape(len(wider), 2, w // 8)
            packed = np.concatenate([np.frombuffer(b"".join(bits[i] for i in own.tolist()), np.uint64).reshape(len(own), w // 8), halves[:, 0] | halves[:, 1]])
            for p, q in BitmapTree(n[rows], packed, comp[rows], PERCENT).pairs():
                new = np.minimum(p, q) < len(own)
                if crossed:
                    new &= side[rows[p]] != side[rows[q]]
                for i, j in zip(rows[p[new]].tolist(), rows[q[new]].tolist(), strict=True):
                    a, b = find(int(cls[i])), find(int(cls[j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)

    for bound, rows in _groups(batches, 4):
        side, cls, comp, n = (rows.column(k).to_numpy() for k in (4, 5, 6, 7))
        bits = rows.column(8).to_pylist()
        crossed = (rows.column(2).to_numpy() != rows.column(3).to_numpy())[bound[:-1]]
        for i, j, x in zip(bound[:-1].tolist(), bound[1:].tolist(), crossed.tolist(), strict=True):
            block(side[i:j], cls[i:j], comp[i:j], n[i:j], bits[i:j], x)
    nodes = sorted(c for c in root if find(c) != c)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(c) for c in nodes], pa.int64())], names=["a", "b"])


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Null, empty and wordless texts have no shingle and are linked with nothing: their
    component is their own id.  Rows that repeat an id or a text are linked as any
    others are.  A row without an id can join a component but not found one.  Other
    columns are not read.
    """
    ship_by_value()
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = written(rows.mapInArrow(T.lean(_profile), _DOCS_DDL), "shingle-profile")
    documents = profile.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "cls", *(f"k{i}" for i in range(KEYS)), "bits")
    frequent = profile.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(f"n >= {FREQUENT}").orderBy(F.desc("n"), "a").limit(FREQUENT_MOST)
    classes = written(documents.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(KEYS)), F.max("bits").alias("bits")), "classes")

    # Groups by min-hash.  Beyond the first key, one class stands for all that share the first key as well.
    own = classes.select(F.xxhash64(F.lit(0), "k0").alias("key"), "cls")
    other = classes.select("k0", "cls", F.explode(F.array(*(F.xxhash64(F.lit(i), f"k{i}") for i in range(1, KEYS)))).alias("key")).groupBy("key", "k0").agg(F.min("cls").alias("cls")).select("key", "cls")
    keyed = own.unionByName(other)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("leader")).where("m > 1")
    salts = F.ceil(F.col("m") / BLOCK_SETS).cast("int")
    members = keyed.join(sizes, "key").select("key", F.pmod(F.xxhash64("cls"), salts).cast("int").alias("salt"), "cls")
    leaders = sizes.where(f"m > {BLOCK_SETS}").select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("leader").alias("cls"))
    blocks = written(members.unionByName(leaders).distinct(), "blocks")

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(parts, *keys).sortWithinPartitions(*keys, "cls")

    def linked(blocks: DataFrame, name: str) -> DataFrame:
        """Links (a, b) inside the blocks (key, salt, cls, comp), by a signature tree each.

        A set is made from one document of its class and goes to its blocks from there: the places come
        to the texts, up to ``BROADCAST_ROWS`` (counted singly) by broadcast, so that no set is dealt by class before.
        """
        place = F.struct("key", F.col("salt").cast("long").alias("salt"), "cls", "comp")
        ids = written(blocks.join(classes.select("cls", "doc_id"), "cls").groupBy("doc_id").agg(F.collect_list(place).alias("places")), "wanted")
        many = ids.agg(F.sum(F.size("places"))).first()[0] or 0
        few = F.broadcast(ids) if many <= BROADCAST_ROWS else ids
        in_blocks = rows.join(few, "doc_id").select("places", "text").mapInArrow(T.lean(_set_rows), "key long, salt long, cls long, comp long, tokens binary")
        links = written(dealt(in_blocks, "key", "salt").mapInArrow(T.lean(_tree_links), "a long, b long").distinct(), name)
        released(ids)
        return links

    def state_of(joined: DataFrame) -> DataFrame:
        return classes.select("cls", "n").join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "n", F.coalesce("component", "cls").alias("comp"))

    links = linked(blocks.withColumn("comp", F.col("cls")), "tree-links")
    released(blocks)
    joined = components(links)

    # Completion: prefix postings of all classes against each other.
    hot = np.sort(frequent.select("a").toArrow().column("a").to_numpy().astype(np.int64).view(np.uint64))
    shared_hot = spark.sparkContext.broadcast(hot.tobytes())
    packed = rows.select("text").mapInArrow(T.lean(_postings(shared_hot, 8 * parts)), "part int, tokens binary, classes binary")
    # Dealt by class once, so that what is told of a class comes to its tokens where they lie.
    shared = dealt_table(packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(T.lean(_shared), "token long, cls long"), "cls", "shared-tokens")
    shared_hot.unpersist()
    swept(spark)
    by_token = lambda df: df.repartition(parts, "token").sortWithinPartitions("token")

    # Around the class of a token whose prefix is shared most, the original of its copies, one more round of blocks.
    scored = state_of(joined).join(shared.groupBy("cls").agg(F.count("*").alias("deg")), "cls").select("cls", "comp", (F.col("deg") / F.greatest(F.col("n"), F.lit(1))).alias("score"))
    centres = by_token(shared.join(scored, "cls").select("token", "cls", "comp", "score")).mapInArrow(T.lean(_centres), "centre long, cls long, c long")
    centres = centres.groupBy("centre", "cls").agg(F.sum("c").alias("c")).groupBy("cls").agg(F.max(F.struct("c", "centre")).alias("best")).select("cls", F.col("best.centre").alias("key"), F.col("best.c").alias("c"))
    centres = centres.join(classes.select("cls", "n"), "cls").where(F.col("c") * 10 >= F.ceil(F.col("n") / 4)).select("key", "cls")
    centres = written(centres, "centres")
    around = centres.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("s"))
    members = centres.join(around, "key").select("key", F.pmod(F.xxhash64("cls"), F.col("s")).cast("int").alias("salt"), "cls")
    heads = around.select("key", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), F.col("key").alias("cls"))
    around_centres = written(members.unionByName(heads).distinct().withColumn("comp", F.col("cls")), "centre-blocks")
    more = linked(around_centres, "centre-links")
    state = written(state_of(components(links.unionByName(more))).select("cls", "comp"), "class-state")
    released(joined, centres, around_centres, links, more)

    # Tokens with the same classes are one list: its name is a sum over its classes.  They are dealt by token once, for both sides of the join.
    owned = shared.join(state, "cls").select("token", "cls", "comp").repartition(parts, "token")
    name = [F.sum(F.xxhash64(F.lit(k), "cls").bitwiseAND((1 << 47) - 1)).alias(f"h{k}") for k in (1, 2)]
    lists = owned.groupBy("token").agg(*name, F.count("*").alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("cls").alias("first")).where("least <> most")
    lists = lists.select("token", "m", "first", F.xxhash64("h1", "h2", "m").alias("list"))
    members = owned.join(lists, "token").select("list", "m", "first", "cls", "comp").distinct()
    # Long lists are cut into sides, and every two sides meet in a block.  Short lists with the same first class lie together.
    s = F.ceil(F.col("m") / LIST_BLOCK).cast("int")
    deal = F.when(F.col("m") <= SHORT_LIST, F.col("first")).otherwise(F.col("list"))
    members = members.select(deal.alias("deal"), "list", "cls", "comp", s.alias("s"), F.pmod(F.xxhash64("cls"), s).cast("int").alias("side"))
    members = members.select("deal", "list", "cls", "comp", "side", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
    members = members.select("deal", "list", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cls", "comp").join(classes.select("cls", "n", "bits"), "cls")
    members = members.select("deal", "list", "lo", "hi", "side", "cls", "comp", "n", "bits").repartition(parts, "deal", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
    clusters = components(members.mapInArrow(T.lean(_list_edges), "a long, b long"))
    released(shared)
    # Of a cluster every two sides of about BLOCK_SETS classes meet in a block, where whole sets decide.
    s = F.ceil(F.col("m") / BLOCK_SETS).cast("int")
    sides = clusters.groupBy("component").agg(F.count("*").alias("m")).select("component", s.alias("s"))
    near = clusters.withColumnRenamed("node", "cls").join(sides, "component").select("component", "cls", "s", F.pmod(F.xxhash64("cls"), F.col("s")).cast("int").alias("side"))
    near = near.select("component", "cls", "s", "side", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other")).where("s = 1 OR side <> other")
    near = near.select(F.col("component").alias("key"), (F.least("side", "other") * F.col("s").cast("long") + F.greatest("side", "other")).alias("salt"), "cls")
    near = written(near.join(state.select("cls", "comp"), "cls").select("key", "salt", "cls", "comp"), "near-blocks")
    more = linked(near, "near-links")
    released(clusters, near)
    comp = state.select("cls", "comp")
    between = more.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    released(more)
    final = comp.join(merged.withColumnRenamed("node", "comp"), "comp", "left").select("cls", F.coalesce("component", "comp").alias("comp"))

    # Ids: the smallest of a class, of a component, then back to the documents.
    of_class = classes.select("cls", "doc_id").join(final, "cls")
    first = of_class.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = of_class.select("cls", "comp").join(first, "comp").select("cls", "component_id", F.pmod("cls", F.lit(7)).alias("fold"))
    out = documents.select("doc_id", "n", "cls", F.pmod("cls", F.lit(7)).alias("fold")).join(named, ["cls", "fold"], "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
