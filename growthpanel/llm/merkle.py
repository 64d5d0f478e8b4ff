"""Merkle manifest of a dataset by time-forward processing over trees of eight children a node.

Nodes are labelled by level and place, so children come before parents. A sweep takes the nodes in the order of their
labels and sends each digest to the parent through a priority queue ordered by label; a reversed sweep sends the siblings'
digests that a proof needs from the root to the leaves. Tasks sweep blocks of up to ``8 ** BAND`` neighbouring nodes, whose
messages a heap holds; between blocks the queue is a sorted shuffle, external and spilled by Spark. A band of levels
is one job, so 10**12 leaves take four upwards and four downwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf, running_offsets

#: children of a node, levels of a block
FAN, BAND = 8, 4
_BLOCK = FAN**BAND
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the fields of a leaf, in order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to. A proof has ``place:siblings`` per level, parted by ``/``."""
    for part in proof.split("/") if proof else ():
        place, siblings = part.split(":")
        cut = 64 * int(place)
        leaf = digest(siblings[:cut], leaf, siblings[cut:])
    return leaf


def _levels(total: int) -> int:
    """Levels above ``total`` nodes within one block."""
    n = 0
    while total > 1 and n < BAND:
        total, n = -(-total // FAN), n + 1
    return n


def sweep_up(digests: list[str], levels: int) -> list[list[str]]:
    """All levels of a block from its lowest one: each node is sent to its parent's label and taken when its turn comes."""
    tree: list[list[str]] = [[] for _ in range(levels + 1)]
    queue = [((0, i), 0, d) for i, d in enumerate(digests)]  # (label of the receiver, place among its children, digest)
    while queue:
        (level, number), place, own = heapq.heappop(queue)
        if level:
            parts = [own]
            while queue and queue[0][0] == (level, number):
                parts.append(heapq.heappop(queue)[2])
            own = digest(*parts)
        tree[level].append(own)
        if level < levels:
            heapq.heappush(queue, ((level + 1, number // FAN), number % FAN, own))
    return tree


def sweep_down(tree: list[list[str]], suffix: str) -> Iterator[tuple[int, str]]:
    """(number, proof) of the nodes of a block's lowest level, from the proof of its highest node."""
    top = len(tree) - 1
    queue = [((-top, i), suffix) for i in range(len(tree[top]))]
    while queue:
        (level, number), proof = heapq.heappop(queue)
        if level == 0:
            yield number, proof
            continue
        run = tree[-level - 1][FAN * number : FAN * (number + 1)]
        for place in range(len(run)):
            part = f"{place}:{''.join(run[:place] + run[place + 1 :])}"
            heapq.heappush(queue, ((level + 1, FAN * number + place), f"{part}/{proof}" if proof else part))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the place of a row among the task's rows of its group, which come one after another."""
    from pyspark import TaskContext

    part, group, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for g in batch.column("grp").to_pylist():
            group, at = (g, 0) if g != group else (group, at + 1)
            places.append(at)
        columns = [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "at"])


def numbered(rows: DataFrame, order: list[Column], shelf: Shelf) -> DataFrame:
    """``rows`` (grp, ...) with ``index``, their place in their group by ``order``, and ``total``, the group's rows.

    Rows are sorted by ranges, whatever the groups' sizes; a group's offsets are one row per range that it touches.
    """
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = shelf.keep(ranged.mapInArrow(_number, f"{schema}, part int, at long"), "ranges")
    sums = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = running_offsets(sums, ["grp"], "part", "n", "offset").withColumn("total", F.sum("n").over(Window.partitionBy("grp")))
    met = placed.join(offsets.drop("n"), ["grp", "part"])
    return met.select(*rows.columns, (F.col("at") + F.col("offset")).alias("index"), "total")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """Rows of each block, which come one after another."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["grp"], row["block"]) != key:
                if held:
                    yield *key, held
                key, held = (row["grp"], row["block"]), []
            held.append(row)
    if held:
        yield *key, held


_NODES = "grp string, index long, total long, digest string"


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = []
    for grp, block, rows in _blocks(batches):
        total = rows[0]["total"]
        top = sweep_up([r["digest"] for r in rows], _levels(total))[-1][0]
        found.append((grp, block, -(-total // _BLOCK), top))
    columns = list(zip(*found)) or [[]] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["grp", "index", "total", "digest"])


_PROOFS = "grp string, index long, proof string, subroot string, root string"
_LEAVES = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof string"
_TYPES = {"index": pa.int64(), "doc_id": pa.int64(), "verified": pa.bool_()}


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its proof, sorted before its nodes, and its nodes in; the proofs of the nodes out."""
    for grp, _, (message, *rows) in _blocks(batches):
        tree = sweep_up([r["digest"] for r in rows], _levels(rows[0]["total"]))
        found = [(grp, rows[n]["index"], proof, message["subroot"], message["root"]) for n, proof in sweep_down(tree, message["proof"])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, _TYPES.get(name, pa.string())) for c, name in zip(zip(*found), _names(_PROOFS))], names=_names(_PROOFS)
        )


def _down_to_leaves(schema: str):
    """Like ``_down``, with what the readers of the leaves get out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, (message, *rows) in _blocks(batches):
            tree, root = sweep_up([r["digest"] for r in rows], _levels(rows[0]["total"])), message["root"]
            found = []
            for number, proof in sweep_down(tree, message["proof"]):
                row = rows[number]
                folded = fold(row["tampered"] or row["digest"], proof)
                siblings = [p.partition(":")[2] for p in proof.split("/")]
                found.append((row["doc_id"], row["digest"], message["subroot"], root, digest(*siblings), folded, folded == root, proof))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, _TYPES.get(name, pa.string())) for c, name in zip(zip(*found), _names(schema))], names=_names(schema)
            )

    return run


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "index")


def _rise(nodes: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """Nodes of every band, the given ones first; the last has one node per group."""
    bands = [nodes]
    while (bands[-1].agg(F.max("total")).first()[0] or 1) > 1:
        blocks = _in_blocks(bands[-1].select("grp", "index", "total", "digest", F.expr(f"index div {_BLOCK}").alias("block")))
        bands.append(shelf.keep(blocks.mapInArrow(_up, _NODES), "band"))
    return bands


def _descend(bands: list[DataFrame], tops: DataFrame, shelf: Shelf, schema: str | None = None) -> DataFrame:
    """Proofs of the lowest nodes, or with ``schema`` the rows of leaves, from ``tops`` (grp, index, proof, subroot, root)."""
    for k in reversed(range(max(1, len(bands) - 1))):
        nodes = bands[k].withColumn("block", F.expr(f"index div {_BLOCK}"))
        messages = tops.withColumnRenamed("index", "block").withColumn("index", F.lit(-1).cast("long"))
        both = _in_blocks(nodes.unionByName(messages, allowMissingColumns=True))
        if k == 0 and schema is not None:
            return both.mapInArrow(_down_to_leaves(schema), schema)
        tops = shelf.keep(both.mapInArrow(_down, _PROOFS), "proofs")
    return tops


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(text if name == "text" else F.col(name)) for name in FIELDS]).cast("binary"), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, proofs: bool = True, shelf: Shelf | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text; further columns are ignored).

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof): ``leaf`` is the digest of the row,
    ``subroot`` that of its language's tree, ``root`` that of the tree of subroots, ``proof`` the siblings that lead
    from leaf to root (read by ``fold``; some 64 bytes a sibling, left out without ``proofs``), and ``folded_root`` what
    they make of the row with its text lower-cased where ``tampered`` (a condition) holds, else of the row as it is.
    ``verified`` says whether that is the root.

    Leaves ascend by doc_id, null first, and by digest where doc_ids are equal, so repeated rows are leaves of their own.
    Null fields, and empty texts, have leaves; rows without a language are a tree of their own. An empty table gives no rows.

    Texts are read once and never shuffled: what moves are digests. A language of any size is dealt into blocks, whose
    nodes one task sweeps; a sort by ranges of doc_id numbers the leaves.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered, _leaf(F.translate("text", _UPPER, _LOWER)))
    group = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("grp")
    rows = docs.select(group, F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("text")).alias("digest"), changed.alias("tampered"))
    leaves = shelf.keep(numbered(shelf.keep(rows, "leaves"), [F.col("doc_id"), F.col("digest")], shelf), "numbered")
    bands = _rise(leaves, shelf)
    subroots = bands[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    placed = shelf.keep(numbered(subroots, [F.col("name")], shelf), "subroots")
    upper = _rise(placed.select("grp", "index", "total", "digest"), shelf)
    unknown = F.lit(None).cast("string").alias("subroot")
    root = upper[-1].select("grp", "index", F.lit("").alias("proof"), unknown, F.col("digest").alias("root"))
    met = placed.select("index", "name", "digest").join(_descend(upper, root, shelf), "index")
    tops = met.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("index"), "proof", F.col("digest").alias("subroot"), "root")
    return _descend(bands, shelf.keep(tops, "tops"), shelf, _LEAVES if proofs else _LEAVES.removesuffix(", proof string"))


def proof_digest(docs: DataFrame) -> DataFrame:
    """The manifest with every row tampered with whose decimal doc_id's unsigned crc32 three divides."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, tampered, proofs=False)


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text in DuckDB: a byte at a time, a bit at a time, with the reversed polynomial."""
    bit = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: {bit}), 4294967295)"


def duckdb_sql(levels: int = 9, upper: int = 3) -> str:
    """The digest of all proofs for up to 8**levels leaves a language and 8**upper languages."""

    def field(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(n) if n != 'text' else field(text) for n in FIELDS)})"

    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    steps = [
        f"leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM (SELECT coalesce('+' || lang, '') AS g, doc_id, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} END AS changed FROM documents))"
    ]

    def climb(name: str, base: str, depth: int) -> str:
        """Runs of each level of a tree; its last step is its top."""
        now = base
        for k in range(depth):
            steps.append(f"{name}_runs{k} AS MATERIALIZED (SELECT g, i // {FAN} AS p, list(d ORDER BY i) AS ds, max(n) AS n FROM {now} GROUP BY ALL)")
            steps.append(
                f"{name}_level{k} AS (SELECT g, p AS i, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, (n + {FAN - 1}) // {FAN} AS n FROM {name}_runs{k})"
            )
            now = f"{name}_level{k}"
        return now

    def prove(name: str, base: str, depth: int) -> str:
        """Rows with ``s``, the siblings, and ``f``, the folded digest, carried through the levels of a tree."""
        now = base
        for k in range(depth):
            place = f"((x.i >> {3 * k}) & {FAN - 1})"
            left, right = f"array_to_string(r.ds[:{place}], '')", f"array_to_string(r.ds[{place} + 2:], '')"
            steps.append(
                f"{name}_proof{k} AS (SELECT x.* REPLACE (CASE WHEN r.n = 1 THEN s ELSE s || {left} || {right} END AS s, CASE WHEN r.n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f) FROM {now} x JOIN {name}_runs{k} r ON x.g = r.g AND x.i >> {3 * k + 3} = r.p)"
            )
            now = f"{name}_proof{k}"
        return now

    steps.append("base AS (SELECT g, i, leaf AS d, n FROM leaves)")
    top = climb("leaf", "base", levels)
    steps.append(f"subroots AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS n FROM {top})")
    steps.append("lang_base AS (SELECT g, i, d, n FROM subroots)")
    root = climb("lang", "lang_base", upper)
    steps.append("start AS (SELECT g, i, doc_id, leaf, '' AS s, coalesce(changed, leaf) AS f FROM leaves)")
    proved = prove("leaf", "start", levels)
    steps.append(f"above AS (SELECT '' AS g, t.i, p.doc_id, p.leaf, t.d AS subroot, p.s, p.f FROM {proved} p JOIN subroots t ON p.g = t.name)")
    last = prove("lang", "above", upper)
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, (SELECT d FROM {root}) AS root, sha256(s) AS proof_sha256, f AS folded_root, f = (SELECT d FROM {root}) AS verified FROM {last}"
    )
