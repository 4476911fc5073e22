"""Ordered rule tables as Column expressions: noise, domains, document classes, clarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the noise predicates.
SYSTEM_TABLES = ("dual", "sysibm", "information_schema", "all_tables", "user_tables")
SQL_KEYWORDS = ("set", "select", "from", "where", "insert", "update", "delete", "values", "into", "table", "create", "alter", "drop", "index")
NOISE_CONTROLLERS = ("exceptionhandlingcontroller", "healthcheckcontroller", "sandboxcontroller", "examplecontroller")
NOISE_PATHS = (
    (r"(?i)/test(?:$|/)", "test_endpoint"),
    (r"(?i)/example/", "example_endpoint"),
    (r"(?i)/metrics/", "metrics_endpoint"),
    (r"(?i)/error$", "error_handler"),
    (r"(?i)/health", "health_check"),
    (r"(?i)/debug", "debug_endpoint"),
    (r"(?i)/internal/", "internal_endpoint"),
    (r"(?i)/getCSRFToken$", "utility_endpoint"),
    (r"(?i)/rsa/", "utility_endpoint"),
    (r"(?i)/getIPAddr$", "utility_endpoint"),
    (r"(?i)/raon/", "security_utility"),
)
INTERNAL_PARTS = ("/internal/", "/health", "/debug", "/test")


def first_rule(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first test that holds."""
    out = F.lit(default).cast("string")
    for test, value in reversed(rules):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def table_noise(name: Column, n_columns: Column) -> Column:
    """Why a table name is no table, or null."""
    low = F.lower(name)
    return first_rule([
        (low.isin(*SYSTEM_TABLES), "system_table"),
        (name.rlike("^[a-zA-Z]$"), "sql_alias"),
        (low.isin(*SQL_KEYWORDS), "sql_keyword"),
        (name.rlike("^[a-z]+[A-Z]") & (n_columns == 0), "variable_name"),
    ])


def api_noise(path: Column, controller: Column) -> Column:
    """Why an endpoint is no business endpoint, or null."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    half = F.floor(F.size(parts) / 2).cast("int")
    doubled = (F.size(parts) >= 4) & (F.slice(parts, F.lit(1), half) == F.slice(parts, half + 1, F.size(parts)))
    return first_rule([(F.lower(controller).isin(*NOISE_CONTROLLERS), "noise_controller"), *((path.rlike(p), why) for p, why in NOISE_PATHS), (doubled, "duplicate_path")])


def is_internal(path: Column) -> Column:
    out = F.lit(False)
    for part in INTERNAL_PARTS:
        out = out | F.lower(path).contains(part)
    return out


def is_external(path: Column) -> Column:
    return ~(is_internal(path) | F.lower(path).contains("/actuator"))


def skip_parameter(name: Column, kind: Column, annotation: Column, path: Column) -> Column:
    """Parameters that documents need not list: headers, credentials, path variables."""
    note = F.lower(F.coalesce(annotation, F.lit("")))
    return note.contains("requestheader") | ((name == "Auth") & (kind == "String")) | note.contains("pathvariable") | path.contains(F.concat(F.lit("{"), name, F.lit("}")))


#: Business domains by path, controller and table, first match wins.
DOMAINS = (
    ("charge", ("/charge", "/chargeDealing", "/comCharge"), ("charge",), ("charg", "auto_charg")),
    ("gift", ("/gift", "/coupon", "/voucher"), ("gift", "coupon"), ("cpn_", "gift", "coupon", "voucher")),
    ("payment", ("/pay", "/approval"), ("pay", "approval"), ("pay", "approval")),
    ("member", ("/join$", "/mp/", "/member", "/withdraw", "/company", "/employee", "/franchise"), ("member", "company", "employee", "franchise"), ("member", "parties", "franchise", "employee")),
    ("auth", ("/auth/", "/login", "/password", "/kmc/"), ("auth", "login", "kmc", "rsa"), ("login", "clause_agree")),
    ("wallet", ("/wallet", "/balance", "/money/"), ("wallet", "money"), ("wallet", "balance", "ledger", "monetary")),
    ("store", ("/store", "/parties"), ("parties", "gis"), ("store", "parties")),
    ("settlement", ("/transfer", "/settleBank", "/openbank"), ("settlebank", "openbank"), ("stlm", "settlement", "deposit", "vrtl_acnt", "nbkk")),
    ("message", ("/message", "/extMessage", "/v[12]/messages", "/send"), ("message", "send", "producer"), ("message", "schedule_msg", "schedule_recipient", "recipient_info")),
    ("batch", ("/extBatch", "/batch", "/api/run"), ("batch", "joblauncher"), ("batch", "stast_batch")),
    ("admin", ("/manual/", "/masking", "/status", "/reset"), ("manual", "masking"), ("ma_sta", "pre_data")),
    ("point", ("/point",), ("point",), ("point", "accml")),
    ("deal", ("/deal", "/cashBack", "/ledger", "/refund"), ("deal", "ledger"), ("deal", "transaction", "refund", "ledger")),
    ("common", ("/common/", "/front/", "/app/", "/utils/"), ("common", "front"), ("com_code", "app_version", "notice", "board", "banner", "event")),
    ("data", (), (), ("card", "account", "budget", "policy", "receipt", "temp_", "api_req", "xroshot")),
)


def gap_domain(path: Column, controller: Column, table: Column) -> Column:
    """Business domain of a gap; absent parts are empty or null."""
    hit = lambda c, patterns: (F.coalesce(c, F.lit("")) != "") & c.rlike("(?i)" + "|".join(patterns))
    rules = [(hit(c, patterns), name) for name, *all_ in DOMAINS for c, patterns in zip((path, controller, table), all_, strict=True) if patterns]
    return first_rule(rules, "unknown")


#: Document classes by keyword, and what the file type adds.
CLASSES = (
    ("erd", ("ERD", "엔터티", "entity", "관계")),
    ("screen_design", ("화면", "UI", "UX", "스크린")),
    ("api_spec", ("API", "endpoint", "swagger")),
    ("requirements", ("요구사항", "requirement", "기능")),
    ("process", ("프로세스", "절차", "업무")),
)


def whole_word(text: Column, word: str) -> Column:
    """ASCII word boundary on both sides, whatever stands next to it."""
    return text.rlike(f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def document_class(text: Column, file_type: Column) -> tuple[Column, Column]:
    """Class and confidence of a document by the keywords in its text; ties go to the class listed first."""
    low = F.lower(text)
    short = [k.lower() for _, keywords in CLASSES for k in keywords if k.isascii() and k.isalpha() and len(k) in (2, 3)]
    # One pass finds the short keywords, which count as whole words only.
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?<![A-Za-z0-9_])({'|'.join(short)})(?![A-Za-z0-9_])"), F.lit(1)))
    hit = lambda k: F.array_contains(found, k.lower()) if k.lower() in short else low.contains(k.lower())
    score = {name: sum((hit(k).cast("double") for k in keywords), F.lit(0.0)) for name, keywords in CLASSES}
    sheet, slides = file_type.isin("xlsx", "xls"), file_type.isin("pptx", "ppt")
    score["requirements"] += F.when(sheet, 0.5).otherwise(0.0)
    score["process"] += F.when(sheet, 0.3).otherwise(0.0)
    score["screen_design"] += F.when(slides, 0.5).otherwise(0.0)
    best = F.greatest(*score.values())
    name = first_rule([((s == best) & (best > 0), n) for n, s in score.items()], "general")
    return name, F.when(best > 0, F.least(F.lit(0.95), 0.5 + best * 0.15)).otherwise(F.lit(0.3))


#: Fixed values of the clarity measures.
GOALS = ("목적", "목표", "개요", "배경", "purpose", "objective", "goal", "overview")
CONDITIONS = (r"(?i)(?<![A-Za-z0-9_])if(?![A-Za-z0-9_])", r"(?i)(?<![A-Za-z0-9_])when(?![A-Za-z0-9_])", r"인\s*경우", r"할\s*때", "하면", "조건", "제약", "기준")
QUANTITY = r"\d+\s*(일|%|원|건|시간|개|명|회|차|개월|년)"
COMPARISONS = ("이상", "이하", "초과", "미만")


def ambiguity(text: Column) -> dict[str, Column]:
    """Goal, constraint and criteria clarity, their weighted complement (4 digits) and whether it exceeds 0.2."""
    low = F.lower(text)
    present = lambda c, words: sum((c.contains(w).cast("int") for w in words), F.lit(0))
    count = lambda p: F.regexp_count(text, F.lit(p))
    goal = F.least(F.lit(1.0), present(low, GOALS) / 5)
    # No two of the patterns can match at one place, so their alternation counts what they count together.
    constraint = F.least(F.lit(1.0), count("|".join(f"(?:{p})" for p in CONDITIONS)) / 8)
    criteria = F.least(F.lit(1.0), (count(QUANTITY) + present(text, COMPARISONS)) / 5)
    score = F.floor((1 - (goal * 0.4 + constraint * 0.3 + criteria * 0.3)) * 10000 + 0.5) / 10000.0
    return {"goal": goal, "constraint": constraint, "criteria": criteria, "ambiguity": score, "rejected": score > 0.2}


#: First bytes of file formats, their labels and file types; words of parse errors.
FILE_HEADS = {"504B0304": ("ZIP/PK", ("xlsx", "docx", "pptx", "zip")), "D0CF11E0": ("OLE2", ("xls", "ppt", "doc")), "25504446": ("%PDF", ("pdf",)), "89504E47": ("PNG", ("png",)), "FFD8FF": ("JPEG", ("jpg", "jpeg"))}
ENCRYPTED_HEAD = "5343445341303032"
TIMEOUT_WORDS, NETWORK_WORDS = ("abort", "timeout"), ("network", "fetch", "econnrefused")


def file_format(content: Column, file_type: Column) -> tuple[Column, Column, Column]:
    """valid, label and error of a file by its first bytes; unknown types are valid."""
    types = FILE_HEADS
    head = F.hex(F.substring(content, 1, 8))
    known = file_type.isin(*(t for _, ts in types.values() for t in ts))
    right = first_rule([(file_type.isin(*ts) & head.startswith(magic), label) for magic, (label, ts) in types.items()])
    small, locked = F.length(content) < 4, head == ENCRYPTED_HEAD
    valid = ~known | (~small & right.isNotNull())
    label = F.when(known & ~small, F.coalesce(right, F.when(locked, "SCDSA002")))
    error = F.when(~known, None).when(small, "too_small").when(right.isNotNull(), None).when(locked, "encrypted_scdsa002").otherwise("wrong_header")
    return valid, label, error


def parse_error(name: Column, message: Column) -> Column:
    """timeout, network_error or parse_error, by the error's name and message."""
    holds = lambda words: F.lower(message).rlike("|".join(words))
    return first_rule([((F.lower(name) == "aborterror") | holds(TIMEOUT_WORDS), "timeout"), (holds(NETWORK_WORDS), "network_error")], "parse_error")


def relevance(external: Column, entity: Column, transaction: Column) -> Column:
    score = external.cast("int") + entity.cast("int") + transaction.cast("int")
    return F.when(score >= 2, "core").when(score == 0, "non-core").otherwise("unknown")


#: Subtypes of workbooks by file name.
SUBTYPES = (
    (r"(?i)화면\s*설계", "화면설계"),
    (r"(?i)(?:프로그램|PGM)\s*설계", "프로그램설계"),
    (r"(?i)테이블\s*(?:정의|설계|목록)", "테이블정의"),
    (r"(?i)배치\s*(?:설계|정의)", "배치설계"),
    (r"(?i)(?:인터페이스|I/F)\s*설계", "인터페이스설계"),
    (r"(?i)단위\s*테스트", "단위테스트"),
    (r"(?i)통합\s*테스트", "통합테스트"),
    (r"(?i)요구\s*사항", "요구사항"),
    (r"(?i)업무\s*규칙", "업무규칙"),
    (r"(?i)코드\s*정의", "코드정의"),
    (r"(?i)정책\s*(?:정의|관리)", "정책정의"),
    (r"(?i)공통\s*(?:설계|정의|모듈)", "공통"),
)


def workbook_subtype(file_name: Column) -> Column:
    return first_rule([(file_name.rlike(p), name) for p, name in SUBTYPES], "unknown")
