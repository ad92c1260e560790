"""Dataset splits that keep related records together.

Records and what they cite are the two kinds of nodes of a graph; a record and all that it is linked to,
directly or through chains, form a group. Groups are found by Boruvka rounds in Spark: every component
picks its smallest outgoing edge, the picked edges join a spanning forest and are contracted. Each round
at least halves the components that still have edges, so a few rounds do, however long the chains or hot
the keys: an edge list is only ever grouped by minimum (combined before the shuffle), never gathered, and
roots that hold many rows are looked up in a table of counted size. The forest is written and
kept by name, so that every group can be traced to the citations that hold it together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.folding import CASELESS
from pageloom.llm.lookalike import consistent_form, fit
from pageloom.session import durable, written

#: Roots above this share of all records are dealt one by one; there can be at most 1 / LARGE of them.
LARGE = 0.001
#: Hash buckets a size band is dealt in at least, and groups of a bucket beyond which there are more; prefix sums run over buckets, then inside each of them.
BUCKETS, HELD = 64, 100_000
#: Roots that are sent to every task, and the share of all rows above which a root is sent where there are more; there are at most 1 / FREQUENT of these.
SENT, FREQUENT = 20_000, 0.001


def page_citations(questions: DataFrame) -> DataFrame:
    """(id, page): what each question cites, one row for each different page, as a key of bare file name and page number.

    File names are compared by their consistent form without directories and outer blanks, letter case aside;
    a null source or page, and a question without id, cites nothing.
    """
    cited = questions.where("id is not null").select("id", F.explode("evidence").alias("e")).where("e.source is not null and e.page is not null")
    names = cited.select("id", F.col("e.page").alias("number"), F.element_at(F.split(F.regexp_replace("e.source", r"\\", "/"), "/"), -1).alias("name"))
    classes = fit(names.select("name"))
    alike = "".join(map(chr, CASELESS)), "".join(CASELESS.values())
    keyed = names.select("id", "number", F.trim(F.translate(F.lower(consistent_form(F.col("name"), classes)), *alike)).alias("name")).where("name <> ''")
    return keyed.select("id", F.concat_ws("#", "name", "number").alias("page")).distinct()


def _numbered(links: DataFrame, member: str, key: str) -> DataFrame:
    """(tag, name, node, n): a number of its own for every member (tag m) and key (tag k) of a written table of links, and its links."""
    names = links.select(F.lit("m").alias("tag"), F.col(member).alias("name")).union(links.select(F.lit("k"), F.col(key)))
    return written(names.groupBy("tag", "name").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))


def _by_number(links: DataFrame, names: DataFrame, tag: str, column: str, number: str, total: int) -> DataFrame:
    """Links with the number of a name; names of many links, at most 1 / FREQUENT, are looked up apart."""
    own = names.where(F.col("tag") == tag).select(F.col("name").alias(column), F.col("node").alias(number), "n")
    many = F.col("n") > FREQUENT * total
    often = own.where(many).drop("n")
    rest = links.join(F.broadcast(often.select(column)), column, "left_anti").join(own.where(~many).drop("n"), column)
    return links.join(F.broadcast(often), column).unionByName(rest)


def _looked_up(rows: DataFrame, moved: DataFrame, columns: list[str], count: int) -> DataFrame:
    """Rows whose roots in some columns have moved get the new ones; a hot root is no hot key of the join."""
    for column in columns:
        there = moved.select(F.col("root").alias(column), F.col("parent").alias("_to"))
        if count <= SENT:
            joined = rows.join(F.broadcast(there), column, "left")
        else:  # roots of many rows are few: they are looked up apart
            frequent = written(rows.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") > FREQUENT * rows.count()).select(column))
            few = there.join(F.broadcast(frequent), column, "left_semi")
            joined = rows.join(F.broadcast(frequent), column, "left_semi").join(F.broadcast(few), column, "left")
            joined = joined.unionByName(rows.join(F.broadcast(frequent), column, "left_anti").join(there, column, "left"))
        rows = joined.withColumn(column, F.coalesce("_to", column)).drop("_to")
    return rows


def spanning_forest(links: DataFrame, member: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(tag, name, node, root) of every node and the forest edges (a, b), for a table of (member, key) links.

    Nodes are numbers, a those of members (tag m) and b those of what they are linked to (tag k), so that no
    two names can meet; links with a null are left out. Both results are checkpointed. The smallest edge of
    a component is unique, because edges are ordered as pairs.
    """
    links = written(links.where(F.col(member).isNotNull() & F.col(key).isNotNull()).select(F.col(member).cast("string"), F.col(key).cast("string")).distinct())
    names, total = _numbered(links, member, key), links.count()
    edges = _by_number(_by_number(links, names, "m", member, "a", total), names, "k", key, "b", total)
    edges = durable(edges.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "a", "b"))
    nodes = durable(names.select("node", F.col("node").alias("root")))
    forest = None
    while not edges.isEmpty():
        low, high = F.least("ra", "rb"), F.greatest("ra", "rb")
        order = F.struct(low.alias("low"), high.alias("high"), "a", "b")
        both = edges.select(F.col("ra").alias("root"), order.alias("edge")).union(edges.select(F.col("rb").alias("root"), order.alias("edge")))
        picked = both.groupBy("root").agg(F.min("edge").alias("edge"))
        towards = F.when(F.col("edge.low") == F.col("root"), F.col("edge.high")).otherwise(F.col("edge.low"))
        picked = durable(picked.select("root", towards.alias("parent"), F.col("edge.a").alias("a"), F.col("edge.b").alias("b")))
        chosen = picked.select("a", "b").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        back = picked.select(F.col("root").alias("parent"), F.col("parent").alias("grand"))
        # two components that picked each other: the smaller becomes the root of the tree
        jump = durable(picked.join(back, "parent", "left").select("root", F.when((F.col("grand") == F.col("root")) & (F.col("root") < F.col("parent")), F.col("root")).otherwise(F.col("parent")).alias("parent")))
        while True:  # pointer jumping: the distance to the root halves with every turn
            up = jump.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
            further = durable(jump.join(up, "parent").select("root", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
            jump = further.select("root", "parent")
            if further.where("moved").isEmpty():
                break
        count = jump.count()
        nodes = durable(_looked_up(nodes, jump, ["root"], count))
        edges = _looked_up(edges, jump, ["ra", "rb"], count).where("ra <> rb").select("ra", "rb", "a", "b")
        # of parallel edges between two components the smallest is enough
        pair = (F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))
        edges = durable(edges.groupBy(*pair).agg(F.min(F.struct("a", "b")).alias("e")).select(F.col("x").alias("ra"), F.col("y").alias("rb"), "e.a", "e.b"))
    forest = durable(forest if forest is not None else nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0))
    return durable(names.select("tag", "name", "node").join(nodes, "node")), forest


def question_groups(questions: DataFrame) -> DataFrame:
    """(id, group), written: every question with an id, once, and the number of its group; one that cites nothing has a negative one of its own."""
    nodes, _ = spanning_forest(page_citations(questions), "id", "page")
    ids = questions.where("id is not null").select("id").distinct()
    held = nodes.where("tag = 'm'").select(F.col("name").alias("id"), "root")
    return written(ids.join(held, "id", "left").select("id", F.coalesce("root", -1 - F.monotonically_increasing_id()).alias("group")))


def forest_citations(questions: DataFrame) -> DataFrame:
    """(id, page, group): the citations of the spanning forest by name, one fewer in a group than it has questions and pages.

    A group falls apart where any of them is taken away; questions that cite nothing are in none.
    """
    nodes, forest = spanning_forest(page_citations(questions), "id", "page")
    cited = forest.join(nodes.select(F.col("node").alias("a"), F.col("name").alias("id"), F.col("root").alias("group")), "a")
    return cited.join(nodes.select(F.col("node").alias("b"), F.col("name").alias("page")), "b").select("id", "page", "group")


def mixed_questions(questions: DataFrame) -> DataFrame:
    """(id) of questions whose group holds more than one split other than null."""
    grouped = question_groups(questions)
    splits = questions.where("id is not null and split is not null").select("id", "split")
    mixed = grouped.join(splits, "id").groupBy("group").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high")
    return grouped.join(mixed, "group", "left_semi").select("id")


def deal_splits(grouped: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, group, split): whole groups dealt to splits so that the records meet the wanted shares.

    Groups are stratified by size band (powers of two). Those above ``LARGE`` of all records, at most
    1 / LARGE of them, are dealt largest first to the split that lacks most; what is then left of the
    shares is met systematically: inside a band, groups stand in hash order, and the place of a group's
    middle record on a low-discrepancy sequence decides. Equal input gives equal splits. Shares are
    taken in proportion to their sum; with no rows the result is empty; null or negative shares count as 0.
    """
    shares = {r.split: max(r.share or 0.0, 0.0) for r in targets.where("split is not null").collect()}
    if not sum(shares.values()) > 0:
        raise ValueError("split targets need at least one positive share")
    sizes = durable(grouped.groupBy("group").agg(F.count("*").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    names = sorted(shares, key=lambda x: (-shares[x], x))
    lack = {x: shares[x] / sum(shares.values()) * total for x in names}
    large = []
    for row in sizes.where(F.col("size") > max(LARGE * total, 1)).orderBy(F.desc("size"), "group").collect():
        best = max(names, key=lambda x: (lack[x], x))
        lack[best] -= row["size"]
        large.append((row["group"], best))
    dealt = grouped.sparkSession.createDataFrame(large, T.StructType([T.StructField("group", grouped.schema["group"].dataType), T.StructField("split", T.StringType())]))
    small = sizes.join(F.broadcast(dealt), "group", "left_anti")
    for part in (small.where("size > 1"), small.where("size = 1")):
        placed = durable(_deal_systematically(part, lack))
        for row in placed.groupBy("split").agg(F.sum("size").alias("n")).collect():
            lack[row["split"]] -= row["n"]
        dealt = dealt.unionByName(placed.select("group", "split"))
    return grouped.join(dealt, "group").select("id", "group", "split")


def _deal_systematically(sizes: DataFrame, lack: dict[str, float]) -> DataFrame:
    """(group, size, split) for groups of similar size, in proportion to what each split still lacks."""
    left = {x: max(y, 0.0) for x, y in lack.items()}
    rest, names = sum(left.values()) or 1.0, list(left)
    buckets = max(BUCKETS, math.ceil(sizes.count() / HELD))
    banded = sizes.withColumn("band", F.floor(F.log2("size")).cast("int")).withColumn("hash", F.xxhash64(F.lit("deal"), "group")).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    totals = banded.groupBy("band", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("band", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("band", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))  # a row for each band and bucket
    inside = Window.partitionBy("band", "bucket").orderBy("hash", "group").rowsBetween(Window.unboundedPreceding, -1)
    placed = banded.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(offsets), ["band", "bucket"])
    middle = F.col("offset") + F.col("before") + F.floor((F.col("size") - 1) / 2)
    golden = (middle * F.lit(0.6180339887498949)) - F.floor(middle * F.lit(0.6180339887498949))
    bounds, total = [], 0.0
    for name in names:
        total += left[name] / rest
        bounds.append((name, total))
    choice = F.lit(bounds[-1][0])
    for name, upper in reversed(bounds[:-1]):
        choice = F.when(golden < upper, F.lit(name)).otherwise(choice)
    return placed.select("group", "size", choice.alias("split"))
