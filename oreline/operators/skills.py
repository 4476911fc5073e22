"""Operators over skills, policies, elements and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import specs as S
from ..functions.rules import first_rule
from ..functions.text import rounded

#: Document classes of workbook subtypes.
SUBTYPE_CLASSES = {
    "화면설계": "screen_design",
    "프로그램설계": "screen_design",
    "테이블정의": "erd",
    "코드정의": "erd",
    "요구사항": "requirements",
    "업무규칙": "requirements",
    "정책정의": "requirements",
    "인터페이스설계": "api_spec",
    "배치설계": "process",
    "단위테스트": "process",
    "통합테스트": "process",
    "공통": "general",
}


def numbered(page: DataFrame, order: list) -> DataFrame:
    """A page - a few rows, already limited - with each row's place ``n``."""
    return page.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))


def fit_entries(entries: DataFrame, key: str, position: str, text: str, most: int, total: int, first: int) -> DataFrame:
    """Entries cut to ``most`` characters; keys still over ``total`` characters keep their ``first`` entries.

    ``first`` counts by ``position``. A null text is kept and counts nothing.
    """
    cut = entries.withColumn(text, S.truncated(F.col(text), most))
    sizes = cut.groupBy(key).agg(F.sum(F.length(text)).alias("_all"))
    long = cut.join(sizes.where(F.col("_all") > total).select(key), key, "left_semi")
    kept = long.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(position))).where(F.col("_k") <= first).drop("_k")
    short = cut.join(sizes.where(F.col("_all") > total).select(key), key, "left_anti")
    return short.unionByName(kept)


def workbook_class(elements: DataFrame, key: str, position: str) -> DataFrame:
    """Class and confidence of each workbook by its first telling element. ``elements``: key, position, type."""
    subtype = F.substring("type", 9, 100)
    sheet = F.col("type").startswith("XlSheet:")
    by_subtype = first_rule([(subtype == k, v) for k, v in SUBTYPE_CLASSES.items()], "general")
    screen = F.col("type").startswith("XlScreen") | (F.col("type") == "XlProgramMeta")
    policy = F.col("type").isin("XlPolicy", "XlTerm", "XlTransactionType")
    kind = F.when(sheet, by_subtype).when(screen, "screen_design").when(policy, "requirements")
    sure = F.when(sheet, F.when(subtype.isin(*SUBTYPE_CLASSES), 0.9).otherwise(0.5)).when(screen, 0.9).otherwise(0.95)
    found = elements.withColumn("_c", kind).groupBy(key).agg(F.min_by(F.struct(F.col("_c").alias("c"), sure.alias("s")), F.when(F.col("_c").isNotNull(), F.col(position))).alias("b"))
    return found.select(key, F.coalesce("b.c", F.lit("general")).alias("class"), F.coalesce("b.s", F.lit(0.3)).alias("confidence"))


#: Classes of single-element sources, in order.
SOURCE_CLASSES = (("CodeController", "source_controller"), ("CodeDataModel", "source_vo"), ("CodeTransaction", "source_service"), ("CodeDdl", "source_ddl"), ("CodeMapper", "source_mapper"))


def source_class(elements: DataFrame, key: str) -> DataFrame:
    """Class of each source upload: a project if it has several kinds of elements, else by its only kind."""
    has = {t: F.bool_or(F.col("type") == t).alias(t) for t, _ in SOURCE_CLASSES}
    g = elements.groupBy(key).agg(*has.values(), F.bool_or(F.col("type") == "SourceProjectSummary").alias("whole"))
    kinds = sum((F.col(t).cast("int") for t in has), F.lit(0))
    name = first_rule([((kinds > 1) | F.col("whole"), "source_project"), *((F.col(t), c) for t, c in SOURCE_CLASSES)], "source_config")
    sure = F.when((kinds > 1) | F.col("whole"), 0.95).when(kinds == 1, 0.9).otherwise(0.5)
    return g.select(key, name.alias("class"), sure.alias("confidence"))


def consensus(first: Column, second: Column) -> Column:
    """Struct of decision, rounds and score of a judge's answers; an unreadable answer is a split, a second split rejects.

    Answers and decisions pass through one-element arrays, so that each is read once.
    """

    def decision(answer: Column) -> Column:
        said = F.get_json_object(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "$.decision")
        return F.transform(F.array(said), lambda s: F.when(s.isin("approve", "reject", "split"), s).otherwise("split"))[0]

    def told(x: Column) -> Column:
        one, two = x["one"], x["two"]
        final = F.when(one != "split", one).when(two != "split", two).otherwise("reject")
        return F.struct(final.alias("decision"), F.when(one == "split", 2).otherwise(1).alias("rounds"), F.when(final == "approve", 0.85).otherwise(0.2).alias("score"))

    return F.transform(F.array(F.struct(decision(first).alias("one"), decision(second).alias("two"))), told)[0]


def criteria_votes(scores: DataFrame, least: float = 0.75, wanted: int = 4, criteria: int = 6) -> DataFrame:
    """Mean score (3 digits) of ``criteria``, how many pass, and whether enough do. ``scores``: key, criterion, score.

    Scores count in thousandths, so that their order of summing does not matter; a
    criterion without a score counts 0.
    """
    g = scores.groupBy("key").agg(F.sum(F.floor(F.col("score") * 1000 + 0.5)).alias("t"), F.count(F.when(F.col("score") >= least, 1)).alias("passed"))
    return g.select("key", (F.floor(F.col("t") / F.lit(float(criteria)) + 0.5) / 1000).alias("total"), "passed", (F.col("passed") >= wanted).alias("ok"))


#: Error codes and states of contracts and what implementations call them, keys whose value is compared as it is, and where others are found.
CONTRACT_ERRORS = {
    "INSUFFICIENT_VOUCHER_BALANCE": "E422-BAL",
    "MERCHANT_INACTIVE": "E409-MS",
    "FULL_REFUND_PERIOD_EXPIRED": "PERIOD_EXPIRED",
    "VOUCHER_NOT_ACTIVE": "E409-VS",
    "VOUCHER_NOT_FOUND": "E404-V",
    "MERCHANT_NOT_FOUND": "E404-M",
}
CONTRACT_STATES = {"PENDING": "REQUESTED", "APPROVED": "COMPLETED"}
SUCCESS_KEYS = ("payment_completed", "cancel_completed", "deposit_requested")
VALUE_KEYS = {"balance_after": "balanceAfter", "rfndPsbltyYn": "rfndPsbltyYn", "deposit_amount": "deposit_amount", "exclusion_amount": "exclusion_amount"}
UNSUPPORTED = "UNSUPPORTED_WHEN"


def renamed(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[value], value)


def compare_contracts(assertions: DataFrame) -> DataFrame:
    """Whether each scenario's assertions hold, and why the first that fails does.

    ``assertions``: scenario, position, key, expected (text), and of the run's outcome ok,
    result (map of texts), sms (whether a message went out) and error (code). A run that
    the prototype does not support fails as UNSUPPORTED_WHEN whatever is asserted; keys
    that nothing is known of hold.
    """
    ok, key, expected, true = F.col("ok"), F.col("key"), F.col("expected"), F.col("expected").eqNullSafe("true")
    value = lambda *names: F.coalesce(*(F.col("result")[n] for n in names))
    wrong = lambda test: F.when(test, "WRONG_VALUE")
    on_success = lambda test: F.when(~ok, "UNEXPECTED_ERROR").otherwise(wrong(test))
    approval = value("cardApprovalId", "approvalId")
    state = F.when(ok, renamed(value("status"), CONTRACT_STATES)).otherwise("REJECTED")
    checks = {
        "refund_rejected": F.when(true & ok, "WRONG_OUTCOME"),
        "balance_unchanged": F.when(ok, "WRONG_OUTCOME"),
        "error_code": F.when(ok, "EXPECTED_ERROR_MISSING").otherwise(wrong(~F.col("error").eqNullSafe(renamed(expected, CONTRACT_ERRORS)))),
        "sms_sent": wrong(true & ~(ok & F.coalesce("sms", F.lit(False)))),
        "balance_restored": on_success(~value("balanceRestored", "amount").eqNullSafe(expected)),
        "card_approval_id": on_success(expected.eqNullSafe("non-null") & (F.coalesce(approval, F.lit("")) == "")),
        "refund_status": F.when(~ok & ~expected.eqNullSafe("REJECTED"), "UNEXPECTED_ERROR").otherwise(wrong(~state.eqNullSafe(renamed(expected, CONTRACT_STATES)))),
        "reject_reason_recorded": on_success(true & ~F.coalesce(F.col("result")["reject_reason_recorded"] == "true", F.lit(False))),
        **{k: F.when(true != ok, "WRONG_OUTCOME") for k in SUCCESS_KEYS},
        **{k: on_success(~F.col("result")[name].eqNullSafe(expected)) for k, name in VALUE_KEYS.items()},
    }
    fail = first_rule([(key == k, v) for k, v in checks.items()], F.lit(None).cast("string"))
    lacking = ~ok & F.coalesce(F.col("error").startswith(UNSUPPORTED + ":"), F.lit(False))
    g = assertions.withColumns({"_f": fail, "_u": lacking}).groupBy("scenario")
    g = g.agg(F.bool_or("_u").alias("_u"), F.min_by("_f", F.when(F.col("_f").isNotNull(), F.col("position"))).alias("_f"))
    return g.select("scenario", F.when(F.col("_u"), UNSUPPORTED).otherwise(F.col("_f")).alias("reason"), (~F.col("_u") & F.col("_f").isNull()).alias("passed"))


def allowed(asked: DataFrame, granted: DataFrame) -> DataFrame:
    """Requests (role, resource, action, ...) with ``allowed``; ``granted`` is the table of permissions, which the planner broadcasts if it is small."""
    keys = ["role", "resource", "action"]
    return asked.join(granted.select(*keys, F.lit(True).alias("_g")).distinct(), keys, "left").withColumn("allowed", F.col("_g").isNotNull()).drop("_g")


def business_sections(policies: DataFrame) -> DataFrame:
    """Policies by domain and type as a markdown section each. ``policies``: domain, type, position, code, title."""
    line = F.concat(F.lit("\n- "), "code", F.lit(": "), "title")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("t")))), lambda x: x["t"])
    g = policies.groupBy("domain", "type").agg(F.count("*").alias("policies"), F.array_join(lines, "").alias("lines"))
    return g.select("domain", "type", "policies", F.concat(F.lit("## "), "domain", F.lit(" / "), "type", F.lit(" ("), F.col("policies").cast("string"), F.lit(")"), "lines").alias("section"))


def review_containers(files: DataFrame) -> DataFrame:
    """What each specification folder holds: rules, contract tests, contract and provenance. ``files``: path."""
    f = files.select(F.regexp_extract("path", "^([^/]+)/", 1).alias("container"), F.regexp_extract("path", "^[^/]+/(.*)$", 1).alias("p"))
    n = lambda test: F.count(F.when(test, 1))
    g = f.groupBy("container").agg(
        n(F.col("p").startswith("rules/")).alias("rules"), n(F.col("p").startswith("tests/")).alias("tests"), F.bool_or(F.col("p") == "contract.yaml").alias("contract"), F.bool_or(F.col("p") == "provenance.yaml").alias("provenance")
    )
    return g.withColumn("complete", (F.col("rules") > 0) & (F.col("tests") > 0) & F.col("contract") & F.col("provenance"))


#: Signals of the readiness criteria.
SCHEMA_WORDS = ("테이블", "컬럼", "스키마", "ERD", "DDL", "필드", "인덱스", "제약조건", "PK", "FK")
QUALITY_WORDS = ("이내", "이상", "이하", "초과", "미만", "TPS", "RPS", "QPS", "latency", "응답시간", "암호화", "마스킹", "감사", "로그", "SLA", "가용성", "무중단", "성능", "보안", "테스트", "검증")
API_SIGN = r"(?i)(?<![A-Za-z0-9_])(api|endpoint|POST|GET|PUT|DELETE|PATCH|REST)(?![A-Za-z0-9_])|/api/"
CAMEL_NAME, SNAKE_NAME = r"(?<![A-Za-z0-9_])[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]+(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])[a-z][a-z0-9]+_[a-z0-9_]+(?![A-Za-z0-9_])"
AMOUNT = r"\d+\s*(%|원|만원|억원|천원|일|년|개월|건|회|명|점|시간|분|초|세|kg|km|m)"
POLICY_CODE, POLICY_DOMAIN = r"^POL-[A-Z]+-[A-Z-]+-\d{3}$", r"^POL-([A-Z]+)-"


def readiness(skills: DataFrame, domain_words: tuple[str, ...], thresholds: dict[str, float], overall: float = 0.8) -> DataFrame:
    """Six readiness criteria of skill packages, their mean (3 digits), verdict and the criteria that fail.

    ``skills``: key, schema_uri, valid, term_uris, skos, policies (array of struct code, title,
    description, condition, criteria, outcome, excerpt, document, tags), sources (array), stages, level,
    trust, author, apis, tables, flows, errors (counts), mcp, openapi.
    """
    p, n = F.col("policies"), F.size("policies")
    share = lambda test: F.when(n > 0, F.size(F.filter(p, test)) / n).otherwise(0.0)
    part = lambda test, weight: F.when(test, weight).otherwise(0.0)
    full = lambda x: F.concat_ws("\n", x["title"], F.coalesce(x["description"], F.lit("")), x["condition"], x["criteria"], x["outcome"])
    excerpt = lambda x: F.coalesce(x["excerpt"], F.lit("")) != ""
    text = F.array_join(F.transform(p, lambda x: F.concat(full(x), F.lit("\n"), F.coalesce(x["excerpt"], F.lit("")))), "\n")
    tags = F.array_join(F.flatten(F.transform(p, lambda x: x["tags"])), " ")
    has = lambda c, words: F.lower(c).rlike("|".join(w.lower() for w in words))
    domains = F.array_distinct(F.filter(F.transform(p, lambda x: F.regexp_extract(x["code"], POLICY_DOMAIN, 1)), lambda c: c != ""))
    rows = skills.select("*", text.alias("_text"), tags.alias("_tags"))
    machine = part(F.col("schema_uri").startswith("https://"), 0.3) + part(F.col("valid"), 0.5) + share(lambda x: x["code"].rlike(POLICY_CODE)) * 0.2
    semantic = part(F.col("term_uris") >= 1, 0.4) + part(F.coalesce("skos", F.lit("")) != "", 0.3) + part(F.size(domains) <= 1, 0.3)
    long = share(lambda x: (F.length(x["condition"]) >= 10) & (F.length(x["criteria"]) >= 10) & (F.length(x["outcome"]) >= 10))
    testable = F.when(n > 0, long * 0.5 + share(excerpt) * 0.3 + F.least(F.lit(1.0), n / 3) * 0.2).otherwise(0.0)
    known = F.array_distinct("sources")
    traceable = part(F.size(known) >= 1, 0.3) + share(lambda x: F.coalesce(F.array_contains(known, x["document"]), F.lit(False))) * 0.5 + part(F.col("stages") >= 3, 0.2)
    whole = (n >= 1) & F.forall(p, lambda x: (x["condition"] != "") & (x["criteria"] != "") & (x["outcome"] != ""))
    words = F.concat("_text", F.lit(" "), "_tags")
    business = part(whole, 0.5) + part(has(words, domain_words), 0.25) + part(F.col("_text").rlike(AMOUNT), 0.25)
    spec = (F.col("apis") + F.col("tables") + F.col("flows") + F.col("errors")) > 0
    api = F.when(spec, F.col("apis") > 0).otherwise(F.col("_text").rlike(API_SIGN))
    data = F.when(spec, (F.col("tables") + F.col("flows") + F.col("errors")) > 0).otherwise(has(F.col("_text"), SCHEMA_WORDS) | F.col("_text").rlike(CAMEL_NAME) | F.col("_text").rlike(SNAKE_NAME))
    technical = part(api, 0.4) + part(data, 0.4) + part(F.col("mcp") | F.col("openapi"), 0.2)
    quality = part(has(F.col("_text"), QUALITY_WORDS), 0.4) + part((F.col("trust") > 0) | (F.col("level") != "unreviewed"), 0.3) + part(share(excerpt) >= 0.5, 0.3)
    mean = F.when(n > 0, F.aggregate(F.transform(p, lambda x: F.length(full(x))), F.lit(0), lambda a, v: a + v) / n).otherwise(0.0)
    human = part(F.col("level").isin("reviewed", "validated"), 0.4) + part((n > 0) & F.forall(p, lambda x: F.length(x["title"]) >= 5), 0.2) + part(mean.between(200, 2000), 0.2) + part(F.coalesce("author", F.lit("")) != "", 0.2)
    scores = {"machineReadable": machine, "semanticConsistency": semantic, "testable": testable, "traceable": traceable, "completeness": (business + technical + quality) / 3, "humanReviewable": human}
    out = rows.select("key", *(s.alias(f"raw_{k}") for k, s in scores.items()))
    out = out.select("*", *(S.criterion(F.col(f"raw_{k}")).alias(k) for k in scores))
    total = sum((F.col(k) for k in scores), F.lit(0.0)) / 6
    failed = F.array_compact(F.array(*(F.when(F.least(F.lit(1.0), F.col(f"raw_{k}")) < thresholds[k], k) for k in scores), F.when(total < overall, "overall")))
    return out.select("key", *scores, rounded(total, 3).alias("overall"), (total >= overall).alias("ready"), failed.alias("failed"))
