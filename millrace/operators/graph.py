"""A property graph over chunks: nodes with term sets, edges by overlap and by section.

Nodes of one and the same term set are one *class*. Edges are kept between classes, with the
membership beside them: nodes of a class are linked to each other with strength 1, nodes of two
linked classes with the classes' strength. No pair is lost, and a set shared by a third of all
nodes costs as much as one of a single node. ``node_edges`` unfolds the edges of chosen nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalise_terms
from ..session import durable

ENTITY, KEYPHRASE, SECTION = "shared_entity", "shared_keyphrase", "hierarchical"
TYPES = (ENTITY, KEYPHRASE, SECTION)
LEAST, SECTION_STRENGTH = 0.05, 0.5
#: Rows of a term's list in one part, meetings of sets in one task, and the most tasks.
LIST_ROWS, MEETINGS, MOST_TASKS = 4096, 8_000_000, 4096
#: Terms of the largest sets whose pairs are counted by sets of terms.
SMALL = 6


def distinct_nodes(nodes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per node; rows that repeat a key are the same but for nulls' sake one is kept."""
    return nodes.where(F.col(key).isNotNull()).dropDuplicates([key])


def term_classes(nodes: DataFrame, terms: str, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(classes, membership): ``(class_id, terms, n_members)`` and ``(key, class_id)``.

    Terms are trimmed, in lower case, distinct and sorted; nodes without any are in no class. The
    class id is the smallest key of its members.
    """
    sets = nodes.select(key, F.array_sort(F.array_distinct(normalise_terms(F.col(terms)))).alias("terms")).where("size(terms) > 0")
    classes = sets.groupBy("terms").agg(F.min(key).alias("class_id"), F.count("*").alias("n_members")).select("class_id", "terms", "n_members")
    return classes, sets.join(classes, "terms").select(key, "class_id")


def class_edges(classes: DataFrame, kind: str, least: float = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(source_id, target_id, relationship_type, shared_properties, strength)`` between classes.

    Jaccard similarity of at least ``least`` > 0, 6 decimals, smaller id first. Columns of the
    classes in ``carry`` come along, as ``_a_`` and ``_b_`` with their name.
    """
    sets = durable(classes.select("class_id", "terms", *carry), "classes")
    pairs = sharing_pairs(sets, sets, F.col("_a_class_id") < F.col("_b_class_id"), least)
    held = [F.col(f"{side}{c}") for c in carry for side in ("_a_", "_b_")]
    return pairs.select(F.col("_a_class_id").alias("source_id"), F.col("_b_class_id").alias("target_id"), F.lit(kind).alias("relationship_type"), "shared_properties", F.round(F.size("shared_properties") / _union(), 6).alias("strength"), *held)


def _union() -> Column:
    return F.col("_a_n") + F.col("_b_n") - F.size("shared_properties")


def sharing_pairs(left: DataFrame, right: DataFrame, wanted: Column, least: float) -> DataFrame:
    """Pairs of sets of a similarity of at least ``least`` > 0 for which ``wanted`` holds: the columns
    of both sides as ``_a_`` and ``_b_`` with their name, and ``shared_properties``.

    Both frames have ``terms``, sorted and distinct, and are read several times: hand over stored
    tables. Sets without a common term cannot qualify, so pairs come from an equi-join on the term.
    Both carry all their terms, so a pair is seen to be met at its first common term; at the others
    it is dropped. Pairs are therefore never shuffled to be counted or made distinct: what is stored
    grows with the terms, not with the pairs. A long list is cut on the left and repeated on the
    right; the number of tasks follows the number of meetings.
    """
    if least <= 0:
        raise ValueError("the least similarity must be positive")
    # a bit for each term; all bits where two terms of a set have the same one
    bits = F.expr("aggregate(terms, 0L, (s, t) -> s | shiftleft(1L, cast(pmod(xxhash64(t), 64) as int)))")
    marked = lambda df: df.select("*", F.size("terms").alias("n"), F.when(F.bit_count(bits) == F.size("terms"), bits).otherwise(F.lit(-1).cast("long")).alias("bits"))
    long = lambda df, side: marked(df).select(*(F.col(c).alias(side + c) for c in [*df.columns, "n", "bits"]), F.explode("terms").alias("term"))
    count = lambda df, name: df.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias(name))
    lists = count(left, "_na").join(count(right, "_nb"), "term")
    meetings = lists.agg(F.sum(F.col("_na") * F.col("_nb"))).first()[0] or 0
    tasks = int(min(MOST_TASKS, meetings // MEETINGS + 1))
    heavy = F.broadcast(lists.where(F.col("_na") > LIST_ROWS).select("term", F.ceil(F.col("_na") / LIST_ROWS).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    a = long(left, "_a_").join(heavy, "term", "left").withColumn("_part", F.pmod(F.xxhash64("_a_class_id"), parts).cast("int")).drop("_parts")
    b = long(right, "_b_").join(heavy, "term", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    a, b = (x.repartition(tasks, "term", "_part") for x in (a, b))
    # one bit in common, and one bit for each term on either side: one term in common, this one
    single = F.bit_count(F.col("_a_bits").bitwiseAND(F.col("_b_bits"))) == 1
    common = F.array_intersect("_a_terms", "_b_terms")
    # sets of sizes a <= b share at most a terms: pairs too unlike in size never qualify
    near = F.least("_a_n", "_b_n") >= least * F.greatest("_a_n", "_b_n")
    met = a.join(b.hint("merge"), ["term", "_part"]).where(wanted & near & (single | (common[0] == F.col("term"))))
    met = met.withColumn("shared_properties", F.when(single, F.array("term")).otherwise(common))
    # where one common term is enough, more are too
    enough = (F.lit(1) >= least * (F.col("_a_n") + F.col("_b_n") - 1)) | (F.size("shared_properties") >= least * _union())
    return met.where(enough).drop("term", "_part", "_a_bits", "_b_bits")


def section_groups(nodes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(key, class_id, n_members)``: nodes of one file with one non-empty parent section.

    Members of a group are linked to each other with strength 0.5; the pairs are not unfolded.
    """
    rows = nodes.select(key, "source_file", "parent_section").where("source_file is not null and coalesce(parent_section, '') <> ''")
    groups = rows.groupBy("source_file", "parent_section").agg(F.min(key).alias("class_id"), F.count("*").alias("n_members"))
    return rows.join(groups, ["source_file", "parent_section"]).select(key, "class_id", "n_members")


def edge_type_counts(nodes: DataFrame, key: str = "chunk_id", least: float = LEAST) -> DataFrame:
    """Number of edges between nodes by kind, from classes: n_a x n_b for each pair of linked
    classes and n (n - 1) / 2 inside a class."""
    parts = None
    for kind, column in ((ENTITY, "entities"), (KEYPHRASE, "keyphrases")):
        classes, _ = term_classes(nodes, column, key)
        part = linked_nodes(classes, least).withColumn("relationship_type", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    groups = section_groups(nodes, key).select("class_id", "n_members").distinct()
    own = groups.agg(F.coalesce(F.sum(F.expr("n_members * (n_members - 1) div 2")), F.lit(0).cast("long")).alias("n_edges")).withColumn("relationship_type", F.lit(SECTION))
    return parts.unionByName(own).select("relationship_type", "n_edges")


def linked_nodes(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """One row, ``n_edges``: pairs of members of linked classes, or of one class.

    Small sets are linked by any common term. How many of their pairs have one is counted without
    the pairs: each set of terms S that some class holds has P(S) pairs that hold it, and by inclusion
    and exclusion the sum of P(S), less where S is even, counts each pair once. So much for sets of up
    to ``SMALL`` terms, which have up to 2 ** SMALL - 1 of these; pairs with a larger one are joined.
    """
    if least <= 0:
        raise ValueError("the least similarity must be positive")
    most = max((n for n in range(1, SMALL + 1) if 1 >= least * (2 * n - 1)), default=0)
    sets = durable(classes.select("class_id", "terms", "n_members"), "classes")
    small, large = sets.where(F.size("terms") <= most), sets.where(F.size("terms") > most)
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("n")
    pairs = F.expr("cast(w as decimal(38,0)) * (w - 1) div 2").cast("decimal(38,0)")
    # a node is paired with every other whose class shares S, members of its own class too
    held = small.select("n_members", F.explode(F.expr("transform(sequence(1, shiftleft(1, size(terms)) - 1), m -> filter(terms, (t, i) -> (shiftright(m, i) & 1) = 1))")).alias("held"))
    counted = held.groupBy("held").agg(F.sum("n_members").alias("w")).select(F.when(F.size("held") % 2 == 1, pairs).otherwise(-pairs).alias("n")).agg(total)
    if large.isEmpty():
        return counted.select(F.col("n").cast("long").alias("n_edges"))
    other = sharing_pairs(large, sets, (F.size("_b_terms") <= most) | (F.col("_a_class_id") < F.col("_b_class_id")), least)
    across = other.select((F.col("_a_n_members") * F.col("_b_n_members")).cast("decimal(38,0)").alias("n")).agg(total)
    inside = large.select(F.expr("n_members * (n_members - 1) div 2").cast("decimal(38,0)").alias("n")).agg(total)
    return counted.unionByName(across).unionByName(inside).agg(total).select(F.col("n").cast("long").alias("n_edges"))


def node_edges(nodes: DataFrame, chosen: DataFrame, key: str = "chunk_id", least: float = LEAST) -> DataFrame:
    """All edges of the chosen nodes (a frame of keys), unfolded: both ends, kind, shared, strength.

    Each edge comes out once, smaller id first. Work and result grow with the neighbours of the
    chosen nodes, not with the graph.
    """
    few = F.broadcast(chosen.select(key).distinct()) if chosen.isLocal() else chosen.select(key).distinct()
    picked = nodes.join(few, key, "left_semi")
    out = None
    for kind, column in ((ENTITY, "entities"), (KEYPHRASE, "keyphrases")):
        terms = lambda df, name, size: df.select(F.col(key).alias(name), F.array_distinct(normalise_terms(F.col(column))).alias("_t")).select(name, F.size("_t").alias(size), F.explode("_t").alias("term"))  # noqa: E731, B023
        pairs = terms(picked, "_x", "_nx").join(terms(nodes, "_y", "_ny"), "term").where("_x <> _y")
        got = pairs.groupBy("_x", "_y", "_nx", "_ny").agg(F.array_sort(F.collect_list("term")).alias("shared_properties"))
        both = F.size("shared_properties")
        union = F.col("_nx") + F.col("_ny") - both
        part = got.where(both >= least * union).select("_x", "_y", F.lit(kind).alias("relationship_type"), "shared_properties", F.round(both / union, 6).alias("strength"))
        out = part if out is None else out.unionByName(part)
    named = lambda df, name: df.where("coalesce(parent_section, '') <> ''").select("source_file", "parent_section", F.col(key).alias(name))
    own = named(picked, "_x").join(named(nodes, "_y"), ["source_file", "parent_section"]).where("_x <> _y")
    out = out.unionByName(own.select("_x", "_y", F.lit(SECTION).alias("relationship_type"), F.array("parent_section").alias("shared_properties"), F.lit(SECTION_STRENGTH).alias("strength")))
    ends = out.select(F.least("_x", "_y").alias("source_id"), F.greatest("_x", "_y").alias("target_id"), "relationship_type", "shared_properties", "strength")
    return ends.distinct()


def multihop_pairs(nodes: DataFrame, key: str = "chunk_id", low: float = 0.4, high: float = 0.82, most: int = 50, prefer_cross: bool = True, distinct_pairs: bool = False) -> DataFrame:
    """Edges of a strength in [low, high], the best ``most`` of them, with ``cross_document``.

    Pairs across files come first, then by source, target and kind of edge; not preferring these,
    order is by distance of the strength from the middle of the band. A pair may come once per kind
    of edge, unless ``distinct_pairs``.

    The list is short, so edges are unfolded from the smallest sources on and only as far as they
    can be in it: when enough pairs across files have been found, no later source can add one (where
    such pairs are rare, all sources are unfolded). By distance from the middle, edges of classes are
    ranked and those of the first classes unfolded, unless of ``distinct_pairs``.
    """
    spark = nodes.sparkSession
    files = nodes.select(key, "source_file")
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("relationship_type"))

    distance = F.round(F.abs(F.col("strength") - (low + high) / 2), 6)

    def ranked(chosen: DataFrame | None, bound) -> DataFrame:
        if chosen is None:
            edges = nearest_edges(nodes, key, low, high, most, distance)
        else:
            edges = node_edges(nodes, chosen, key).where(F.col("strength").between(low, high))
        if bound is not None:
            edges = edges.where(F.col("source_id") <= bound)
        named = edges.join(files.toDF("source_id", "_fa"), "source_id").join(files.toDF("target_id", "_fb"), "target_id")
        named = named.withColumn("cross_document", ~F.col("_fa").eqNullSafe(F.col("_fb"))).drop("_fa", "_fb").withColumn("_k", kind)
        if distinct_pairs:
            best = named.groupBy("source_id", "target_id").agg(F.min(F.struct("_k", "relationship_type", "shared_properties", "strength", "cross_document")).alias("_e"))
            named = best.select("source_id", "target_id", "_e.*")
        first = F.when(F.col("cross_document"), 0).otherwise(1) if prefer_cross else distance
        return named.orderBy(first, "source_id", "target_id", "_k").limit(most).drop("_k")

    if prefer_cross:
        for size in (most, 8 * most):
            head = [r[0] for r in files.select(key).orderBy(key).limit(size).collect()]
            if len(head) < size:
                break
            found = ranked(spark.createDataFrame([(k,) for k in head], files.select(key).schema), head[-1])
            if found.where("cross_document").count() >= most:
                return found
    elif not distinct_pairs:
        return ranked(None, None)
    return ranked(files.select(key), None)


def nearest_edges(nodes: DataFrame, key: str, low: float, high: float, most: int, distance: Column) -> DataFrame:
    """Edges of nodes among which are the first ``most`` of a strength in [low, high], by distance
    (of ``strength``), source, target and kind.

    The first edge between two classes is that of their smallest members. Of each kind only the
    ``most`` pairs of classes that come first by it can be in the list, as each brings an edge, and
    of a class only its ``most`` + 1 smallest members: for an edge of a later one, those of the
    earlier ones with its other end come first.
    """
    out = None
    whole = lambda df: df.where("n_members > 1").withColumn("strength", F.lit(1.0)).where(F.col("strength").between(low, high)).orderBy("class_id").limit(most)
    for kind, column in ((ENTITY, "entities"), (KEYPHRASE, "keyphrases")):
        classes, member = term_classes(nodes, column, key)
        across = class_edges(classes, kind, max(LEAST, low - 1e-6)).where(F.col("strength").between(low, high))
        across = across.orderBy(distance, "source_id", "target_id").limit(most).select("source_id", "target_id", "shared_properties", "strength")
        inside = whole(classes).select(F.col("class_id").alias("source_id"), F.col("class_id").alias("target_id"), F.col("terms").alias("shared_properties"), "strength")
        part = _unfolded(across.unionByName(inside), member, kind, key, most)
        out = part if out is None else out.unionByName(part)
    if low <= SECTION_STRENGTH <= high:
        member = section_groups(nodes, key)
        groups = member.where("n_members > 1").select("class_id").distinct().orderBy("class_id").limit(most)
        named = groups.join(nodes.select(F.col(key).alias("class_id"), "parent_section"), "class_id")
        own = named.select(F.col("class_id").alias("source_id"), F.col("class_id").alias("target_id"), F.array("parent_section").alias("shared_properties"), F.lit(SECTION_STRENGTH).alias("strength"))
        out = out.unionByName(_unfolded(own, member, SECTION, key, most))
    return out


def _unfolded(edges: DataFrame, member: DataFrame, kind: str, key: str, most: int) -> DataFrame:
    """Edges of the first ``most`` + 1 members of few classes."""
    edges = durable(edges, "nearest")
    few = F.broadcast(edges.select(F.explode(F.array("source_id", "target_id")).alias("class_id")).distinct())
    order = Window.partitionBy("class_id").orderBy(key)
    first = durable(member.join(few, "class_id", "left_semi").select("class_id", key, F.row_number().over(order).alias("_no")).where(F.col("_no") <= most + 1).drop("_no"), "members")
    both = edges.join(first.toDF("source_id", "_x"), "source_id").join(first.toDF("target_id", "_y"), "target_id")
    both = both.where((F.col("source_id") != F.col("target_id")) | (F.col("_x") < F.col("_y")))
    return both.select(F.least("_x", "_y").alias("source_id"), F.greatest("_x", "_y").alias("target_id"), F.lit(kind).alias("relationship_type"), "shared_properties", "strength")


def incident_edges(edges: DataFrame, node: int) -> DataFrame:
    """Edges of a frame of edges at one node or class."""
    return edges.where((F.col("source_id") == node) | (F.col("target_id") == node))


def node_by_id(nodes: DataFrame, node: int, key: str = "chunk_id") -> DataFrame:
    return nodes.where(F.col(key) == node)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Edges come with the targets of a term's list in one order for each source of the list. Written
    as plain numbers, not in a dictionary's odd bits, these repeats are what compression finds."""
    nodes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary#target_id", "false").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of terms after clean-up."""
    from ..functions.text import jaccard

    return jaccard(F.array_distinct(normalise_terms(a)), F.array_distinct(normalise_terms(b)))
