"""Merkle manifest of documents: aligned appends with incremental witnesses; the roots of blocks are appended in turn."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipmill.llm.common import lean, ranked, stored

#: Nodes of a run; levels of runs that one task closes within a block, which so holds FANOUT ** LEVELS leaves.
FANOUT, LEVELS = 8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<before: string, after: string>>"
STEPS_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Witness:
    """What proves a node: its siblings to the left, those to the right as they come, and the witness of the run's parent."""

    __slots__ = ("before", "after", "above")

    def __init__(self):
        self.before, self.after, self.above = "", [], None

    def steps(self) -> list[tuple[str, str]]:
        """Siblings before and after the path, level by level, as far as subtrees are closed."""
        found, at = [], self
        while at.above is not None:
            found.append((at.before, "".join(at.after)))
            at = at.above
        return found


class Appender:
    """A tree that grows by nodes from left to right. Only the open run of each level is held.

    An appended node gets the siblings that stand before it, and extends the witnesses of those, each of which its whole
    subtree shares. A full run closes: its parent is appended a level above.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.open = fanout, [[]]

    def append(self, node: str, level: int = 0) -> Witness:
        run, own = self.open[level], Witness()
        own.before = "".join(d for d, _ in run)
        for _, w in run:
            w.after.append(node)
        run.append((node, own))
        if len(run) == self.fanout:
            self.close(level)
        return own

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        if level + 1 == len(self.open):
            self.open.append([])
        above = self.append(digest("".join(d for d, _ in run)), level + 1)
        for _, w in run:
            w.above = above

    def finish(self, levels: int) -> str:
        """The one node at this level, after the runs below it are closed."""
        for level in range(levels):
            if self.open[level]:
                self.close(level)
        return self.open[levels][0][0]


def height(n: int) -> int:
    """Levels to close in a block of a group of n nodes: as many as leave one node, at most LEVELS."""
    level = 0
    while level < LEVELS and FANOUT**level < n:
        level += 1
    return level


@lean
def block_roots(batches):
    """Rows (_g, _block, _n, node) sorted by group, block and place; a row per block, which is a node of the level above."""
    key, tree, n = None, None, 0

    def root():
        most = FANOUT**LEVELS
        return pa.RecordBatch.from_pydict({"_g": pa.array([key[0]], pa.string()), "_pos": [key[1]], "_n": [-(-n // most)], "node": [tree.finish(height(n))]})

    for batch in batches:
        for g, block, size, node in zip(*(batch[c].to_pylist() for c in ("_g", "_block", "_n", "node")), strict=True):
            if (g, block) != key:
                if tree:
                    yield root()
                key, tree, n = (g, block), Appender(), size
            tree.append(node)
    if tree:
        yield root()


def _blocks(batches, columns: tuple[str, ...]):
    """Block by block: what the level above knows of the block (its top and the steps from the block to it), its nodes, their witnesses."""
    key, tree, known, n, rows, held = None, None, None, 0, [], []
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("_g", "_block", "_pos", "_n", "node", "steps", *columns)), strict=True):
            if row[:2] != key:
                if held:
                    tree.finish(height(n))
                    yield known, rows, held
                key, tree, rows, held = row[:2], Appender(), [], []
            if row[2] < 0:
                known = row
            else:
                n = row[3]
                rows.append(row)
                held.append(tree.append(row[4]))
    if held:
        tree.finish(height(n))
        yield known, rows, held


@lean
def block_witnesses(batches):
    """For each node of a level its group's top and the steps up to it."""
    for known, rows, held in _blocks(batches, ("top",)):
        above = [(s["before"], s["after"]) for s in known[5]]
        steps = [[{"before": b, "after": a} for b, a in (*w.steps(), *above)] for w in held]
        yield pa.RecordBatch.from_pydict({"_g": pa.array([r[0] for r in rows], pa.string()), "_pos": [r[2] for r in rows], "top": [known[6]] * len(rows), "steps": pa.array(steps, STEPS_ARROW)})


@lean
def proofs(batches):
    """For each leaf its proof, and the root that folds out of it, or out of the tampered one, with the siblings."""
    for known, rows, held in _blocks(batches, ("id", "other", "top", "root")):
        above, top, root = [(s["before"], s["after"]) for s in known[5]], known[8], known[9]
        out = []
        for row, w in zip(rows, held, strict=True):
            steps = (*w.steps(), *above)
            folded = row[4] if row[7] is None else row[7]
            for before, after in steps:
                folded = digest(before + folded + after)
            out.append((row[6], row[4], digest("".join(b + a for b, a in steps)), folded))
        ids, leaves, proof, folded = zip(*out, strict=True)
        yield pa.RecordBatch.from_pydict({
            "id": pa.array(ids, pa.int64()), "leaf": leaves, "subroot": [top] * len(ids), "root": [root] * len(ids), "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded],
        })


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows dealt by group and block, in their order."""
    return rows.repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_pos")


def with_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_pos") / FANOUT**LEVELS).cast("long"))


def block_tops(nodes: DataFrame) -> DataFrame:
    """(_g, _block, top, steps) for the blocks of nodes (_g, _pos, _n, node): each group's top node, and the steps to it.

    The roots of blocks are nodes of a level above, appended there in the same way, until each group has one node.
    """
    ordered = in_blocks(with_block(nodes).select("_g", "_block", "_pos", "_n", "node"))
    roots = stored(ordered.mapInArrow(block_roots, "_g string, _pos long, _n long, node string"), "roots")
    if (roots.agg(F.max("_n")).first()[0] or 0) <= 1:
        return roots.select("_g", F.col("_pos").alias("_block"), F.col("node").alias("top"), F.array().cast(STEPS).alias("steps"))
    return node_tops(roots).withColumnRenamed("_pos", "_block")


def node_tops(nodes: DataFrame) -> DataFrame:
    """(_g, _pos, top, steps) for nodes (_g, _pos, _n, node)."""
    low = with_block(nodes).select("_g", "_block", "_pos", "_n", "node", F.lit(None).cast(STEPS).alias("steps"), F.lit(None).cast("string").alias("top"))
    high = block_tops(nodes).select("_g", "_block", F.lit(-1).cast("long").alias("_pos"), F.lit(0).cast("long").alias("_n"), F.lit("").alias("node"), "steps", "top")
    return stored(in_blocks(low.unionByName(high)).mapInArrow(block_witnesses, f"_g string, _pos long, top string, steps {STEPS}"), "steps")


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 bytes with their number before them; null is told from any text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)), 256)


def lower_cased(text: Column) -> Column:
    """A change that a manifest must find: A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def manifest(docs: DataFrame, tampered: Column | None = None, change=lower_cased) -> DataFrame:
    """A row per document with leaf, subroot (its language's), root, proof_sha256, folded_root and verified.

    Leaves ascend by doc_id within a language, nulls first; repeated ids follow their leaves, and equal rows stand side by
    side with a proof each. A null language is one of its own, the first. Where `tampered` holds, folded_root starts from
    the leaf of the changed text (null stays null, so that it still verifies). Texts are hashed where they are read; what
    is shuffled are digests. A language of any size is dealt in blocks of 512 leaves. Columns other than the five that
    enter a leaf aren't looked at, whatever their names. An empty table gives an empty one.
    """
    other = F.when(F.lit(False) if tampered is None else tampered, leaf_of(change(F.col("text"))))
    # Stored first: the bounds of range partitions take a pass of their own, which shouldn't hash texts again.
    leaves = stored(docs.select(F.col("lang").alias("_g"), F.col("doc_id").alias("id"), leaf_of(F.col("text")).alias("node"), other.alias("other")), "leaves")
    leaves = stored(ranked(leaves, "_g", ["id", "node"]), "placed")
    tops = stored(block_tops(leaves), "tops")
    subroots = ranked(tops.where("_block = 0").select(F.lit("").alias("_g"), F.col("_g").alias("lang"), F.col("top").alias("node")), "_g", ["lang"], "subroots")
    subroots = stored(subroots, "places")
    roots = node_tops(subroots).select("_pos", F.col("top").alias("root"), F.col("steps").alias("_more"))
    above = subroots.join(roots, "_pos").select(F.col("lang").alias("_lang"), "root", "_more")
    low = with_block(leaves).select("_g", "_block", "_pos", "_n", "node", F.lit(None).cast(STEPS).alias("steps"), "id", "other", F.lit(None).cast("string").alias("top"), F.lit(None).cast("string").alias("root"))
    high = tops.join(above, F.col("_g").eqNullSafe(F.col("_lang"))).select(
        "_g", "_block", F.lit(-1).cast("long").alias("_pos"), F.lit(0).cast("long").alias("_n"), F.lit("").alias("node"), F.concat("steps", "_more").alias("steps"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("other"), "top", "root",
    )
    made = in_blocks(low.unionByName(high)).mapInArrow(proofs, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return made.withColumnRenamed("id", "doc_id")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


def _tree(name: str, group: str, levels: int) -> str:
    """CTEs {name}1 ... from {name}0 ({group}, pos, node): each level's nodes, and {name}s0 ... with their siblings."""
    ctes = []
    for k in range(levels):
        run = f"PARTITION BY {group}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
        ctes.append(f"""{name}s{k} AS (
  SELECT {group}, pos, node, count(*) OVER (PARTITION BY {group}) AS n,
         coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name}{k}),
{name}{k + 1} AS (
  SELECT {group}, pos // {FANOUT} AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node
  FROM {name}s{k} GROUP BY {group}, pos // {FANOUT})""")
    return ",\n".join(ctes)


def _fold(name: str, group: str, levels: int, start: str, to: str) -> str:
    """CTEs that carry fold and proof of {start} (pos{to}, fold, proof) up through the levels; the last is {to}{levels}."""
    ctes = [f"{to}0 AS (SELECT * FROM {start})"]
    for k in range(levels):
        ctes.append(f"""{to}{k + 1} AS (
  SELECT a.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.before || a.fold || s.after) ELSE a.fold END AS fold,
                      CASE WHEN s.n > 1 THEN a.proof || s.before || s.after ELSE a.proof END AS proof)
  FROM {to}{k} a JOIN {name}s{k} s ON a.{group} IS NOT DISTINCT FROM s.{group} AND s.pos = a.{to}pos // {FANOUT**k})""")
    return ",\n".join(ctes)


def _leaf(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


#: Seven levels hold 2,097,152 documents of a language, two levels 64 languages.
SQL = f"""
WITH d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} AS other,
         list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda i: (ascii((doc_id::VARCHAR)[i // 8 + 1]) >> (i % 8)::INTEGER) & 1) AS bits
  FROM documents),
t AS (
  SELECT doc_id, lang, leaf,
         CASE WHEN xor(list_reduce(bits, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) % 3 = 0
              THEN other ELSE leaf END AS fold,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM d),
l0 AS (SELECT lang, pos, leaf AS node FROM t),
{_tree("l", "lang", 7)},
r0 AS (SELECT 0 AS everything, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, lang, node FROM l7),
{_tree("r", "everything", 2)},
start AS (SELECT t.doc_id, t.lang, t.leaf, t.fold, '' AS proof, t.pos AS apos, r0.pos AS bpos, 0 AS everything, r0.node AS subroot
          FROM t JOIN r0 ON t.lang IS NOT DISTINCT FROM r0.lang),
{_fold("l", "lang", 7, "start", "a")},
{_fold("r", "everything", 2, "a7", "b")}
SELECT b2.doc_id, b2.leaf, b2.subroot, r2.node AS root, sha256(b2.proof) AS proof_sha256, b2.fold AS folded_root, b2.fold = r2.node AS verified
FROM b2 CROSS JOIN r2
"""
