"""Deterministic scoring models: importance, diagnosis, readiness, policy checks, votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import first_rule
from . import matching as M

#: Pass thresholds of the readiness criteria.
READINESS = {"machineReadable": 0.9, "semanticConsistency": 0.7, "testable": 0.7, "traceable": 0.8, "completeness": 0.5, "humanReviewable": 0.6}


#: Weights of importance, least scores of its categories, and what makes a process core or overspecified.
WEIGHTS = {"frequency": 0.2, "dependency": 0.2, "domain": 0.35, "centrality": 0.25}
CATEGORIES = ((0.8, "mega"), (0.6, "core"), (0.3, "supporting"))
CORE_IMPORTANCE, CORE_DOMAIN = 0.7, 0.8
LITTLE_IMPORTANCE, MANY_STEPS = 0.2, 5
#: Fixed value: a Hangul phrase before a word for "when", "in case", "after" or "before".
CONDITION_PHRASE = r"([가-힣]+(?:\s[가-힣]+)?)\s(?:시|경우|때|후|전)"


def importance_category(score: Column) -> Column:
    return first_rule([(score >= least, name) for least, name in CATEGORIES], "peripheral")


def process_importance(processes: DataFrame, rules: DataFrame, relations: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Importance of each process of a document: references, dependencies, domain words, connected entities.

    ``processes``: doc, name, description, steps; ``rules``: doc, condition, outcome;
    ``relations``: doc, src, dst. Names are sought within their document only.
    """
    key = ["doc", "name"]
    p = processes.select("doc", "name", "description", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"))
    names = p.select("doc", "name").distinct()
    texts = (
        rules.select("doc", F.explode(F.array("condition", "outcome")).alias("t"), F.lit("rule").alias("kind"), F.lit(None).cast("string").alias("other"))
        .union(relations.select("doc", "src", F.lit("from"), "dst"))
        .union(relations.select("doc", "dst", F.lit("to"), "src"))
    )
    sought = names.select("doc", F.col("name").alias("s"))
    # Exploded rows are more than Spark takes them for: hints keep it from sending them to all.
    hits = texts.hint("merge").join(M.held_in(sought, texts.select("doc", F.col("t").alias("l")), ["doc"]).select("doc", F.col("s").alias("name"), F.col("l").alias("t")), ["doc", "t"])
    by = hits.groupBy(*key).agg(F.count("*").alias("refs"), F.sum((F.col("kind") == "to").cast("int")).alias("deps"), F.count_distinct("other").alias("linked"))
    steps = p.select("doc", F.col("name").alias("owner"), F.monotonically_increasing_id().alias("_row"), F.explode("steps").alias("l"))
    inside = M.held_in(sought, steps, ["doc"]).hint("merge").join(steps, ["doc", "l"]).where("owner <> s").select("doc", F.col("s").alias("name"), "_row").distinct()
    inside = inside.groupBy(*key).agg(F.count("*").alias("in_steps"))
    n = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name)).hint("merge")
    sized = p.join(n(rules, "n_rules"), "doc", "left").join(n(relations, "n_relations"), "doc", "left").join(n(processes, "n_processes"), "doc", "left").join(by.hint("merge"), key, "left").join(inside.hint("merge"), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    within = Window.partitionBy("doc")
    total = zero("n_rules") * 2 + zero("n_relations") * 2 + F.col("n_processes") - 1
    frequency = F.when(total > 0, F.least(F.lit(1.0), (zero("refs") + zero("in_steps")) / F.greatest(total * 0.1, F.lit(1.0)))).otherwise(0.0)
    share = lambda c: F.least(F.lit(1.0), zero(c) / F.greatest(F.max(zero(c)).over(within), F.lit(1)))
    text = F.concat_ws(" ", "name", "description", F.array_join("steps", " "))
    domain = F.least(F.lit(1.0), reduce(lambda a, b: a + b, [text.contains(k).cast("int") for k in keywords], F.lit(0)) / 5)
    scored = sized.select(*key, F.size("steps").alias("n_steps"), frequency.alias("frequency"), share("deps").alias("dependency"), domain.alias("domain"), share("linked").alias("centrality"))
    score = T.rounded(reduce(lambda a, b: a + b, [F.col(c) * w for c, w in WEIGHTS.items()]), 2)
    return scored.withColumn("importance", score).withColumn("category", importance_category(F.col("importance"))).withColumn("is_core", (F.col("importance") >= CORE_IMPORTANCE) | (F.col("domain") >= CORE_DOMAIN))


#: How sure findings of each kind are, and the text around the type and name of a missing reference.
SURE = {"missing": 0.75, "overspec": 0.65, "inconsistency": 0.6}
MISSING_TEXT = ("관계(", ")에서 참조하는 '", "'이(가) 엔티티/프로세스 목록에 정의되어 있지 않습니다.")
CONDITION_TEXT = ("규칙 조건에서 참조하는 '", "'에 대응하는 프로세스가 정의되어 있지 않습니다.")


def finding(kind: str, level: str, evidence: Column, other: Column | None = None, sure: Column | None = None, related: Column | None = None) -> list[Column]:
    """The columns of a finding behind doc and name."""
    return [
        (F.lit(None).cast("string") if other is None else other).alias("other"), F.lit(kind).alias("type"), F.lit(level).alias("severity"),
        (F.lit(SURE.get(kind)) if sure is None else sure).alias("confidence"), evidence.alias("evidence"), (F.array().cast("array<string>") if related is None else related).alias("related"),
    ]


def told_once(found: DataFrame, text: Column) -> DataFrame:
    """Of candidates (doc, name, _at, ...) the first of each name, and only those whose name no text of an earlier one of the document holds."""
    first = found.withColumn("_rn", F.row_number().over(Window.partitionBy("doc", "name").orderBy("_at"))).where("_rn = 1").withColumn("_text", text)
    held = M.held_in(first.select("doc", F.col("name").alias("s")), first.select("doc", F.col("_text").alias("l")), ["doc"])
    before = held.hint("merge").join(first.select("doc", F.col("_text").alias("l"), F.col("_at").alias("_then")), ["doc", "l"]).groupBy("doc", F.col("s").alias("name")).agg(F.min("_then").alias("_then"))
    return first.hint("merge").join(before, ["doc", "name"]).where(~(F.col("_then") < F.col("_at"))).drop("_rn", "_text", "_then", "_at")


def missing_references(relations: DataFrame, processes: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends of relations that are neither entities nor processes of the document, once each.

    ``relations``: doc, position, src, dst, type; ``processes`` and ``entities``: doc, name.
    A name that the text of an earlier finding's candidate holds is not told again.
    """
    named = processes.select("doc", "name").distinct()
    known = named.union(entities.select("doc", "name")).distinct()
    of = lambda c: named.select("doc", F.col("name").alias(c), F.lit(True).alias(f"_{c}")).hint("merge")
    r = relations.join(of("src"), ["doc", "src"], "left").join(of("dst"), ["doc", "dst"], "left")
    ends = r.select("*", F.posexplode(F.array("src", "dst")).alias("_end", "name")).where("name is not null")
    lost = ends.join(known.hint("merge"), ["doc", "name"], "left_anti").withColumn("_at", F.struct("position", "_end"))
    evidence = F.concat(F.lit("relationship: "), "src", F.lit(" → "), "dst", F.lit(" (type: "), "type", F.lit(")"))
    related = F.array_compact(F.array(F.when(F.col("_src"), F.col("src")), F.when(F.col("_dst"), F.col("dst"))))
    once = told_once(lost.select("doc", "name", "_at", "type", evidence.alias("_e"), related.alias("_r")), F.concat(F.lit(MISSING_TEXT[0]), "type", F.lit(MISSING_TEXT[1]), "name", F.lit(MISSING_TEXT[2])))
    return once.select("doc", "name", *finding("missing", "warning", F.col("_e"), related=F.col("_r")))


def overspecified(importance: DataFrame) -> DataFrame:
    """Processes of little importance with many steps."""
    few = importance.where((F.col("importance") < LITTLE_IMPORTANCE) & (F.col("n_steps") > MANY_STEPS))
    evidence = F.concat(F.lit("importanceScore="), F.col("importance").cast("string"), F.lit(", steps="), F.col("n_steps").cast("string"))
    return few.select("doc", "name", *finding("overspec", "info", evidence, related=F.array("name")))


def orphan_conditions(rules: DataFrame, processes: DataFrame) -> DataFrame:
    """Phrases before 시/경우/때/후/전 in rule conditions that no process name contains or is contained in.

    ``rules``: doc, position, condition, outcome. A phrase that an earlier finding's text holds is not told again.
    """
    evidence = F.concat(F.lit('rule condition: "'), "condition", F.lit('" → outcome: "'), "outcome", F.lit('"'))
    refs = rules.select("doc", "position", evidence.alias("_e"), F.posexplode(F.regexp_extract_all("condition", F.lit(CONDITION_PHRASE), F.lit(1))).alias("_i", "name")).where(F.length("name") >= 2)
    phrases, names = refs.select("doc", F.col("name").alias("s")), processes.select("doc", F.col("name").alias("s"))
    longer = M.held_in(phrases, names.withColumnRenamed("s", "l"), ["doc"]).select("doc", F.col("s").alias("name"))
    shorter = M.held_in(names, phrases.withColumnRenamed("s", "l"), ["doc"]).select("doc", F.col("l").alias("name"))
    lost = refs.join(longer.union(shorter).distinct().hint("merge"), ["doc", "name"], "left_anti").withColumn("_at", F.struct("position", "_i"))
    once = told_once(lost.select("doc", "name", "_at", "_e"), F.concat(F.lit(CONDITION_TEXT[0]), "name", F.lit(CONDITION_TEXT[1])))
    return once.select("doc", "name", *finding("inconsistency", "warning", F.col("_e")))


def readiness_summary(scores: DataFrame) -> DataFrame:
    """Mean of the criteria and verdict per key: ``scores`` has key, criterion, score."""
    least = reduce(lambda acc, kv: F.when(F.col("criterion") == kv[0], kv[1]).otherwise(acc), READINESS.items(), F.lit(0.75))
    passed = scores.withColumn("ok", F.col("score") >= least)
    g = passed.groupBy("key").agg(T.rounded(F.avg("score"), 3).alias("overall"), F.sum(F.col("ok").cast("long")).alias("n_passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("criterion")))), ",").alias("failed"))
    return g.withColumn("ready", F.col("overall") >= 0.8)


def policy_checks(policies: DataFrame, least: int = 10) -> DataFrame:
    """Formal faults of policies (id, code, condition, criteria, outcome, tags): verdict and issue codes."""
    short = [F.when(F.length(F.coalesce(c, F.lit(""))) < least, f"MECH_SHORT_{c.upper()}") for c in ("condition", "criteria", "outcome")]
    code = F.when(~F.coalesce(F.col("code"), F.lit("")).rlike(r"^POL-[A-Z]+-[A-Z-]+-\d{3}$"), "MECH_INVALID_CODE")
    tag = F.when(F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t) == ""), "MECH_EMPTY_TAG")
    issues = F.array_compact(F.array(*short, code, tag))
    return policies.select("id", issues.alias("issues"), F.when(F.size(issues) == 0, "pass").otherwise("fail").alias("verdict"))


def vote_verdict(share: Column) -> Column:
    """APPLICABLE from two thirds, NOT_APPLICABLE to one third, else split."""
    return first_rule([(share >= 0.67, "APPLICABLE"), (share <= 0.33, "NOT_APPLICABLE")], "SPLIT")


def handoff_gate(overall: Column, verdict: Column) -> Column:
    return (overall >= 0.75) & (verdict != "DENIED")


def marker_status(manual: Column, found: Column, supported: Column) -> Column:
    """Recommended status of a marker: unknown without a detector, open if found, else resolved."""
    return first_rule([(~supported, "UNKNOWN"), (found > 0, "OPEN")], "RESOLVED")


def keyword_class(text: Column, classes: dict[str, tuple[tuple[str, ...], float]]) -> Column:
    """Struct of the class with the highest score, and its confidence: keywords that the text holds anywhere, without case, times the class's weight.

    ``classes`` gives the keywords and weight of each, a rule set like any other parameter.
    The first class wins ties; no keyword at all is ``uncategorized`` with confidence 0.
    Confidence is the score over three tenths of the class's keywords, 1 at most, to two digits.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def scored(place: int, name: str, words: tuple[str, ...], weight: float) -> Column:
        hits = reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in words], F.lit(0))
        score = hits * F.lit(float(weight))
        sure = T.rounded(F.least(F.lit(1.0), score / F.lit(len(words) * 0.3 or 1.0)), 2)
        return F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("class"), sure.alias("confidence"))

    best = F.array_max(F.array(*(scored(i, name, words, weight) for i, (name, (words, weight)) in enumerate(classes.items()))))
    found = best["score"] > 0
    return F.struct(F.when(found, best["class"]).otherwise("uncategorized").alias("class"), F.when(found, best["score"]).otherwise(0.0).alias("score"), F.when(found, best["confidence"]).otherwise(0.0).alias("confidence"))
