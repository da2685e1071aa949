"""Secret scan by an inverted index of trigrams, in DataFrame operations alone.

Each rule's regex implies a Boolean query over trigrams. Postings (trigram, document) are made of the trigrams that any
query names; the queries intersect them, and rules are verified only on their candidates. A rule without mandatory
trigrams reads every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.llm.common import stage, texts
from tracelane.llm.secret_rules import BASE, RULES, Rule, trigram_query

SPAN = "struct<start:int,rank:int,end:int>"


def postings(source: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """id, digest, trigram: which of the queries' trigrams each text holds, in lower case."""
    wanted = sorted({t for r in rules for clause in trigram_query(r.regex) for option in clause for t in option})
    low = source.select("id", "digest", F.lower("text").alias("low"))
    return low.select("id", "digest", F.explode(F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.col("low").contains(t))).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """of, of_digest, kinds: the rules whose queries hold for a document. The queries are a table of constants."""
    rows = [(r.kind, c, o, len(option), len(trigram_query(r.regex)), t) for r in rules for c, clause in enumerate(trigram_query(r.regex)) for o, option in enumerate(clause) for t in option]
    query = index.sparkSession.createDataFrame(rows, "kind string, clause int, option int, need int, clauses int, trigram string")
    hits = index.join(F.broadcast(query), "trigram")
    held = hits.groupBy("id", "digest", "kind", "clauses", "clause", "option", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    whole = held.groupBy("id", "digest", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return whole.groupBy(F.col("id").alias("of"), F.col("digest").alias("of_digest")).agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches of a rule, leftmost and non-overlapping, as structs of start, rank and end in code points. The pieces
    between the matches give the places: a match starts where the pieces and matches before it end."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["between"])
        end = begin + F.length(x["found"])
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["sized"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"), sized.alias("sized"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: its id, text, the columns in carry, and spans (array of start, rank, end; rank: the rule's place in rules), by start, then
    rank. Spans of several rules may overlap; those of one don't.

    Null texts are empty and have no spans; rows of one id are scanned each; a null id is allowed; an empty table gives an
    empty one; columns not named are not read.
    """
    extra = [F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)]
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *extra).withColumn("digest", F.xxhash64("text"))
    index = stage(postings(source, rules), "secrets-postings")
    chosen = stage(candidates(index, rules), "secrets-candidates")
    met = source.join(chosen, source.id.eqNullSafe(F.col("of")) & (source.digest == F.col("of_digest")), "left")
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for rank, rule in enumerate(rules):
        needed = F.array_contains("kinds", rule.kind) if trigram_query(rule.regex) else F.col("text").rlike(rule.pattern)
        found.append(F.when(needed, spans(F.col("text"), rule, rank)).otherwise(none))
    out = met.select("id", "text", *[f"carry_{i}" for i in range(len(carry))], F.array_sort(F.concat(*found)).alias("spans"))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "spans")


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of spans, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and digests of scan()'s spans."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def of(rank: int) -> Column:
        return F.filter("spans", lambda s: s["rank"] == rank)

    count = [F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select(id_col, *count, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every covered stretch replaced by the mask; spans by start, as scan() gives them."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(found, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
