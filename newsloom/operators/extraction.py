"""Entities and relations of sentences, from a lexicon and name patterns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.columns import let
from newsloom.functions.text import SENTENCE_END, WS, strip
from newsloom.lexicon import DEFAULT_RELATION, SOURCE_RELATION, Lexicon

#: Name patterns.
COMPANY = rf"(?:^|[，。；：、{WS}])([㐀-鿿A-Za-z0-9·]{{2,18}}?(?:股份有限公司|有限责任公司|集团|银行|证券|保险|科技|公司))"
QUOTED = "[《“\"]([^》”\"]{3,32})[》”\"]"
INLINE = 500  # terms of a list that are written out as expressions
_ENTITY = "struct<name:string,type:string,pos:int>"


def sentences(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Rows of ``chunks`` by sentence: ``sent_no`` and ``sentence``, stripped, blank ones left out."""
    return chunks.select("*", F.posexplode(F.split(text, SENTENCE_END)).alias("sent_no", "sentence")).withColumn("sentence", strip(F.col("sentence"))).where("sentence <> ''")


def _entity(name: Column, kind: Column | str, pos: Column) -> Column:
    return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), pos.cast("int").alias("pos"))


def _matches(sentence: Column, pattern: str) -> Column:
    """Group 1 of each match with its place: places are sums of the text before and of earlier matches."""
    none = F.array().cast("array<struct<name:string,pos:int>>")
    read = F.struct(
        F.split(sentence, pattern, -1).alias("between"),
        F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)).alias("inner"),
    )

    def walked(m: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(m["between"], i))
            place = (start + F.instr(F.get(m["whole"], i), F.get(m["inner"], i)) - 1).cast("int")
            return F.struct((start + F.length(F.get(m["whole"], i))).alias("at"), F.concat(acc["found"], F.array(F.struct(F.get(m["inner"], i).alias("name"), place.alias("pos")))).alias("found"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m["whole"]) - 1), F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])

    return let(read, lambda m: F.when(F.size(m["whole"]) > 0, walked(m)).otherwise(none))


def _table(rows: list[tuple[str, str]]) -> Column:
    """A long list as one literal (surface, name), folded once and walked by each row."""
    return F.from_json(F.lit(json.dumps([{"s": s, "n": n} for s, n in rows], ensure_ascii=False)), "array<struct<s:string,n:string>>")


def _terms(sentence: Column, terms: list[tuple[str, str]], kind: str) -> Column:
    """(canonical, first place) of each term in the sentence, in the order of ``terms``; a long list is a literal, not an expression a term."""
    if not terms:
        return F.array().cast(f"array<{_ENTITY}>")
    if len(terms) > INLINE:
        tried = F.transform(_table(terms), lambda t: _entity(t["n"], kind, F.instr(sentence, t["s"]) - 1))
    else:
        tried = F.array(*(_entity(F.lit(canonical), kind, F.instr(sentence, surface) - 1) for surface, canonical in terms))
    return F.filter(tried, lambda e: e["pos"] >= 0)


def _first(sentence: Column, terms: list[tuple[str, str]], default: str | None) -> Column:
    """The name of the first term that stands in the sentence."""
    if len(terms) > INLINE:
        return F.coalesce(F.get(F.filter(_table(terms), lambda t: F.instr(sentence, t["s"]) > 0), F.lit(0))["n"], F.lit(default).cast("string"))
    return F.coalesce(*(F.when(sentence.contains(s), n) for s, n in terms), F.lit(default).cast("string"))


def candidates(sentence: Column, lexicon: Lexicon) -> Column:
    """All entity candidates in order of trial: institutions, companies, industries, quoted names."""
    companies = F.transform(_matches(sentence, COMPANY), lambda m: _entity(m["name"], "公司", m["pos"]))
    policy = F.lit(False)
    quoted = F.filter(F.transform(_matches(sentence, QUOTED), lambda m: F.struct(strip(m["name"]).alias("name"), m["pos"].alias("pos"))), lambda m: m["name"] != "")

    def kind(name: Column) -> Column:
        hit = policy
        for word in lexicon.policy_words:
            hit = hit | name.contains(word)
        return F.when(hit, "政策").otherwise("事件")

    return F.concat(_terms(sentence, list(lexicon.institutions), "机构"), companies, _terms(sentence, [(t, t) for t in lexicon.industries], "行业"), F.transform(quoted, lambda m: _entity(m["name"], kind(m["name"]), m["pos"])))


def entities_of(sentence: Column, lexicon: Lexicon) -> Column:
    """One entity a name, at its smallest place (ties: first tried), in order of place."""
    start = lambda n, i: F.struct(F.lit(2_000_000_000).alias("pos"), i.alias("first"), n.alias("name"), F.lit("").alias("type"))

    def best(tried: Column) -> Column:
        def nearer(a: Column, e: Column) -> Column:
            return F.when(e["pos"] < a["pos"], F.struct(e["pos"].alias("pos"), a["first"].alias("first"), a["name"].alias("name"), e["type"].alias("type"))).otherwise(a)

        names = F.array_distinct(F.transform(tried, lambda e: e["name"]))
        return F.array_sort(F.transform(names, lambda n, i: F.aggregate(F.filter(tried, lambda e: e["name"] == n), start(n, i), nearer)))

    return let(candidates(sentence, lexicon), best)


def relation_of(sentence: Column, lexicon: Lexicon) -> Column:
    """The label of the first rule whose marker stands in the sentence."""
    return _first(sentence, list(lexicon.rules), DEFAULT_RELATION)


def event_of(sentence: Column, lexicon: Lexicon) -> Column:
    """The first event term, in declared order, that stands in the sentence; else null."""
    return _first(sentence, [(t, t) for t in lexicon.events], None)


def _edge(source: Column, relation: Column | str, target: Column, confidence: Column | float, source_type: Column, target_type: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return F.struct(source.alias("source"), lit(relation).alias("relation"), target.alias("target"), lit(confidence).cast("double").alias("confidence"), source_type.alias("source_type"), lit(target_type).alias("target_type"))


def extract_relations(chunks: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Relations of chunks (chunk_id, doc_id, title, content): one row per source, relation, target and chunk.

    Where a chunk repeats an edge, the last values hold at the first place. ``sent_no`` and
    ``emit_no`` give the order of emission in a chunk. Empty titles are nodes like others, null
    titles give no edge.
    """
    rows = sentences(chunks.select("chunk_id", "doc_id", "title", "content"))
    label, event = relation_of(F.col("sentence"), lexicon), event_of(F.col("sentence"), lexicon)

    def edges_of(x: Column) -> Column:
        found, label, event = x["found"], x["label"], x["event"]
        n = F.size(found)
        strength = F.when(label == DEFAULT_RELATION, 0.55).otherwise(0.72)
        adjacent = F.zip_with(F.slice(found, F.lit(1), n - 1), F.slice(found, F.lit(2), n - 1), lambda a, b: _edge(a["name"], label, b["name"], strength, a["type"], b["type"]))
        only = F.get(found, F.lit(0))
        single = F.array(_edge(only["name"], label, event, 0.62, only["type"], "事件"))
        none = F.slice(single, F.lit(1), F.lit(0))
        inner = F.when(n >= 2, adjacent).when((n == 1) & event.isNotNull() & (event != only["name"]), single).otherwise(none)
        sources = F.when(F.col("title").isNotNull(), F.transform(found, lambda e: _edge(e["name"], SOURCE_RELATION, F.col("title"), 1.0, e["type"], "文档"))).otherwise(none)
        return F.concat(inner, sources)

    read = F.struct(entities_of(F.col("sentence"), lexicon).alias("found"), label.alias("label"), event.alias("event"))
    edges = rows.select("chunk_id", "doc_id", "sent_no", F.posexplode(let(read, edges_of)).alias("emit_no", "e")).select("chunk_id", "doc_id", "sent_no", "emit_no", "e.*")
    place = F.struct("sent_no", "emit_no")
    merged = edges.groupBy("source", "relation", "target", "chunk_id").agg(
        F.min(place).alias("at"), F.max_by(F.struct("doc_id", "confidence", "source_type", "target_type"), place).alias("last")
    )
    return merged.select("source", "relation", "target", "chunk_id", "last.*", "at.sent_no", "at.emit_no")
