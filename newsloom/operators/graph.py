"""The relation graph: merge of relations, question terms, seeds and bounded traversal."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.runtime import materialize

#: Fixed value: words of a question.
TERM = r"[㐀-鿿]{2,}|[A-Za-z0-9_]{2,}"
KEYS = ["source", "relation", "target", "chunk_id", "doc_id"]
DEFAULT_LIMIT = 30


def relation_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *KEYS), 256), 1, 32)


def merge_relations(rows: DataFrame) -> DataFrame:
    """One row per relation id of (seq, relation columns): the first row's place and types, the last row's confidence.

    The partial aggregate keeps one row a key on each task, so that no source name is hot.
    """
    return (
        rows.where(" and ".join(f"{k} is not null" for k in KEYS))
        .groupBy(*KEYS)
        .agg(
            F.min("seq").alias("seq"),
            F.max_by("confidence", "seq").alias("confidence"),
            F.min_by(F.struct("source_type", "target_type"), "seq").alias("types"),
        )
        .select(relation_id().alias("id"), "seq", *KEYS, "confidence", F.coalesce("types.source_type", F.lit("Entity")).alias("source_type"), F.coalesce("types.target_type", F.lit("Entity")).alias("target_type"))
    )


def upsert_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merged relations with a later batch: known ids take its confidence only."""
    columns = ["seq", *KEYS, "confidence", "source_type", "target_type"]
    return merge_relations(old.select(columns).unionByName(new.select(columns)))


def entity_table(relations: DataFrame) -> DataFrame:
    """Distinct (name, entity_type) of both ends."""
    ends = F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("entity_type")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("entity_type")))
    return relations.select(F.explode(ends).alias("e")).select("e.*").distinct()


def scoped(relations: DataFrame, doc_ids: list[str] | None) -> DataFrame:
    return relations.where(F.col("doc_id").isin(doc_ids)) if doc_ids else relations


def question_terms(questions: DataFrame, aliases: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``questions`` with ``terms``: distinct words in order, lower case, and both names of each alias that occurs."""
    words = F.transform(F.regexp_extract_all("question", F.lit(TERM), F.lit(0)), lambda w: F.lower(w))
    parts = [words]
    if aliases:
        table = F.from_json(F.lit(json.dumps([{"a": a, "c": c} for a, c in aliases], ensure_ascii=False)), "array<struct<a:string,c:string>>")
        hit = F.filter(table, lambda x: (F.instr(F.col("question"), x["a"]) > 0) | (F.instr(F.col("question"), x["c"]) > 0))
        parts.append(F.flatten(F.transform(hit, lambda x: F.array(F.lower(x["a"]), F.lower(x["c"])))))
    return questions.withColumn("terms", F.array_distinct(F.concat(*parts)))


def _grams(text: Column) -> Column:
    """Single characters and neighbouring pairs, each once."""
    n = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array(F.substring(text, i, F.lit(1)), F.substring(text, i, F.lit(2))))))


def _keyed(texts: DataFrame, column: str, grams: DataFrame) -> DataFrame:
    """``texts`` with ``gram``: the one of a text's characters and pairs that stands in the fewest of the other side's texts (``grams``: gram, n).

    A text with one that stands in none of them can't be inside any, and is left out.
    """
    own = texts.select(column, F.explode(_grams(F.col(column))).alias("gram"))
    rated = own.join(grams, "gram", "left").groupBy(column).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    return rated.where("least.n > 0").select(column, F.col("least.gram").alias("gram"))


def _inside(small: DataFrame, inner: str, large: DataFrame, outer: str) -> DataFrame:
    """``inner, outer``: distinct texts of ``small`` that stand in distinct texts of ``large``.

    An equi-join by the rarest character pair of the inner text, so that a usual pair joins nothing
    that a rarer one can.
    """
    spread = large.select(outer, F.explode(_grams(F.col(outer))).alias("gram"))
    return _keyed(small, inner, spread.groupBy("gram").agg(F.count("*").alias("n"))).join(spread, "gram").where(F.col(outer).contains(F.col(inner))).select(inner, outer)


def seeds(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id, name``: graph nodes that a question names.

    A node is a seed if the question holds its name, or a term holds it, or it holds a term (the
    last two in lower case). The tests run on equi-joins by character pairs of the distinct texts, not on all
    pairs of questions and nodes.
    """
    nodes = names.where("name is not null").select("name", F.lower("name").alias("low"))
    q = questions.where(F.size("terms") > 0).select("query_id", "question", "terms")
    exact = _inside(nodes.select("name").distinct(), "name", q.select("question").distinct(), "question").join(q.select("query_id", "question"), "question").select("query_id", "name")
    terms = q.select("query_id", F.explode("terms").alias("term"))
    distinct_terms, low = terms.select("term").distinct(), nodes.select("low").distinct()
    by_term = _inside(distinct_terms, "term", low, "low").unionByName(_inside(low, "low", distinct_terms, "term")).distinct()
    named = terms.join(by_term, "term").join(nodes, "low").select("query_id", "name")
    empty = q.select("query_id", F.lit("").alias("name")).join(nodes.select("name").distinct(), "name").select("query_id", "name")
    return exact.unionByName(named).unionByName(empty).distinct()


def adjacency(relations: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``name, seq, id, source, target``: of each node its 2 * limit earliest relations; made once for an index.

    Only a query with fewer than ``limit`` relations goes on, so of a node's relations its
    2 * limit earliest decide: fewer than ``limit`` of them can have been seen before, and the
    rest fill the query. That bounds what a hub node (a title, a frequent body) sends, without a
    change of the result.
    """
    # edges that differ in their document only are one edge: the earliest
    edges = relations.groupBy("source", "relation", "target", "chunk_id").agg(F.min(F.struct("seq", "id")).alias("e")).select("source", "target", "e.seq", "e.id")
    ends = edges.select("seq", "id", "source", "target", F.explode(F.array_distinct(F.array("source", "target"))).alias("name"))
    return ends.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("seq"))).where(F.col("n") <= 2 * max(1, limit)).drop("n")


def traverse(seeded: DataFrame, relations: DataFrame, hops: int = 2, limit: int = DEFAULT_LIMIT, near: DataFrame | None = None) -> DataFrame:
    """``query_id, id, hop, pos``: the relations within ``hops`` of the seeds, in order of (hop, seq), cut at ``limit``.

    ``near`` is the adjacency of ``relations`` for this limit or a larger one, if there is one. Every hop is a
    written table, and all hops share the same adjacency.
    """
    hops, limit = max(1, hops), max(1, limit)
    near = materialize(adjacency(relations, limit), "adjacency") if near is None else near
    frontier = materialize(seeded.select("query_id", "name").distinct(), "frontier")
    visited, seen = frontier, None
    for hop in range(1, hops + 1):
        reached = frontier.join(near, "name").select("query_id", "id", "seq", "source", "target").distinct()
        if seen is not None:
            reached = reached.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        reached = reached.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))).where(F.col("n") <= limit).drop("n").withColumn("hop", F.lit(hop))
        seen = materialize(reached if seen is None else seen.unionByName(reached), "seen")
        if hop == hops:
            break
        unfinished = seen.groupBy("query_id").count().where(F.col("count") < limit).select("query_id")
        ends_of = seen.where(F.col("hop") == hop).select("query_id", F.explode(F.array("source", "target")).alias("name")).distinct()
        frontier = materialize(ends_of.join(unfinished, "query_id", "left_semi").join(visited, ["query_id", "name"], "left_anti"), "frontier")
        visited = visited.unionByName(frontier)
    order = Window.partitionBy("query_id").orderBy("hop", "seq")
    return seen.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("query_id", "id", "hop", "pos")


def reach_scope(seeded: DataFrame, relations: DataFrame, wanted: DataFrame, hops: int) -> DataFrame:
    """``query_id, id, hop``: the relations of ``wanted`` within ``hops`` of the seeds, without a limit.

    As in a traversal of all ``relations``, edges that differ in their document only are the earliest. A relation's hop is one
    more than the distance of its nearer end, so distances of names are kept, not the relations on the way, and only of names
    from which a wanted relation can still be met.
    """
    edge = ["source", "relation", "target", "chunk_id"]
    first = relations.join(wanted.select(*edge).distinct(), edge, "left_semi").groupBy(*edge).agg(F.min(F.struct("seq", "id")).alias("e")).select("e.id")
    goals = materialize(wanted.join(first, "id", "left_semi").select("id", F.explode(F.array_distinct(F.array("source", "target"))).alias("name")), "goals")
    ways = relations.select(F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("target").alias("other")), F.struct(F.col("target").alias("name"), F.col("source").alias("other")))).alias("w")).select("w.*")
    useful = [goals.select("name").distinct()]  # names from which a wanted relation is so many steps away at most
    for _ in range(hops - 1):
        nearer = useful[-1]
        useful.append(materialize(nearer.union(ways.join(nearer.withColumnRenamed("name", "other"), "other", "left_semi").select("name")).distinct(), "useful"))
    frontier = materialize(seeded.join(useful[-1], "name", "left_semi").select("query_id", "name").distinct(), "frontier")
    known = frontier.withColumn("far", F.lit(0))
    for step in range(1, hops):
        into = useful[hops - 1 - step]
        steps = ways.join(into.withColumnRenamed("name", "other"), "other", "left_semi").distinct()
        next_ = frontier.join(steps, "name").select("query_id", F.col("other").alias("name")).distinct()
        frontier = materialize(next_.join(known.select("query_id", "name"), ["query_id", "name"], "left_anti"), "frontier")
        known = known.unionByName(frontier.withColumn("far", F.lit(step)))
    return known.join(goals, "name").groupBy("query_id", "id").agg((F.min("far") + 1).alias("hop"))


def fallback(questions: DataFrame, seeded: DataFrame, relations: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``query_id, id, hop, pos`` for questions with terms but no seed: relations whose name holds a term."""
    terms = questions.join(seeded.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode("terms").alias("term"))
    labels = relations.select("relation").distinct().select("relation", F.explode(_grams(F.lower("relation"))).alias("gram"))
    hits = terms.withColumn("gram", F.substring("term", 1, 2)).join(labels, "gram").where(F.lower("relation").contains(F.col("term"))).select("query_id", "relation").distinct()
    first = relations.withColumn("n", F.row_number().over(Window.partitionBy("relation").orderBy("seq"))).where(F.col("n") <= max(limit, 0)).select("relation", "id", "seq")
    order = Window.partitionBy("query_id").orderBy("seq")
    return hits.join(first, "relation").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("query_id", "id", F.lit(0).alias("hop"), "pos")


def search(questions: DataFrame, relations: DataFrame, hops: int = 2, limit: int = DEFAULT_LIMIT, doc_ids: list[str] | None = None, aliases: tuple[tuple[str, str], ...] = (), dialect: str = "native", near: DataFrame | None = None) -> DataFrame:
    """Relations for each question (query_id, question), best first: ``query_id, pos, hop`` and the relation.

    ``relations`` are merged ones. Dialect ``path`` clamps the hops to 1..4, takes seeds by the
    first two tests only, has no fallback, and applies the document scope after the traversal. ``near``:
    the adjacency of ``relations``, read instead of made; a scope inside the traversal makes its own.
    """
    if dialect not in ("native", "path"):
        raise ValueError("dialect must be native or path")
    scope = scoped(relations, doc_ids) if dialect == "native" else relations
    asked = question_terms(questions, aliases)
    names = scope.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    found_seeds = materialize(seeds(asked, names), "seeds")
    if dialect == "path":
        terms = asked.select("query_id", "question", "terms")
        direct = F.col("question").contains(F.col("name")) | F.exists("terms", lambda t: F.lower("name").contains(t))
        found_seeds = found_seeds.join(terms, "query_id").where(direct).select("query_id", "name")
        hops = min(4, max(1, hops))
        if not doc_ids:
            return traverse(found_seeds, scope, hops, limit, near).where(F.col("pos") <= limit).join(relations, "id")
        wanted = scoped(relations, doc_ids)
        kept = reach_scope(found_seeds, relations, wanted, hops).join(wanted, "id")
        order = Window.partitionBy("query_id").orderBy("hop", "seq")
        return kept.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    hits = traverse(found_seeds, scope, hops, limit, None if doc_ids else near).unionByName(fallback(asked, found_seeds, scope, limit))
    return hits.join(scope, "id")


def counts(relations: DataFrame) -> DataFrame:
    """``entities, relations``: one row."""
    return count_rows({"entities": entity_table(relations), "relations": relations})


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, by one aggregate."""
    marked = None
    for name in tables:
        rows = tables[name].select(F.lit(name).alias("name"))
        marked = rows if marked is None else marked.unionByName(rows)
    return marked.agg(*(F.count_if(F.col("name") == name).alias(name) for name in tables))


def simple_edges(relations: DataFrame) -> DataFrame:
    """One edge per (source, target): the last relation and confidence."""
    return relations.groupBy("source", "target").agg(F.max_by("relation", "seq").alias("relation"), F.max_by("confidence", "seq").alias("confidence"))


#: Colours by entity type.
COLOURS = {"公司": "#2563eb", "机构": "#7c3aed", "行业": "#059669", "政策": "#dc2626", "事件": "#d97706", "文档": "#64748b", "Entity": "#0891b2"}


def node_styles(relations: DataFrame) -> DataFrame:
    """``name, entity_type, degree, size, label, colour`` of the simple graph; a loop counts twice."""
    simple = simple_edges(relations)
    degree = simple.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").cast("int").alias("degree"))
    ends = F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type"), F.lit(0).alias("turn")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("type"), F.lit(1).alias("turn")))
    types = relations.select("seq", F.explode(ends).alias("e")).groupBy("e.name").agg(F.max_by("e.type", F.struct("seq", "e.turn")).alias("entity_type"))
    colour = F.lit(COLOURS["Entity"])
    for kind, value in COLOURS.items():
        colour = F.when(F.col("entity_type") == kind, value).otherwise(colour)
    label = F.when(F.length("name") <= 12, F.col("name")).otherwise(F.concat(F.substring("name", 1, 11), F.lit("…")))
    return degree.join(types, "name").select("name", "entity_type", "degree", F.least(F.lit(48), 20 + 4 * F.col("degree")).alias("size"), label.alias("label"), colour.alias("colour"))


