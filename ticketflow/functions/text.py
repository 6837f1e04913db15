"""Message text functions as native column expressions (E4-E8, E11, E12,
E15, E16, F9, F10, P5, P6, S9).

Everything here is a ``Column`` built from Spark SQL functions, so it runs
inside whole-stage codegen with no Python in the executor.

JavaScript-vs-Java regex differences the reference code depends on are
handled explicitly: JS ``\\s`` and ``trim`` include U+3000 and other Unicode
spaces (Java's do not), JS ``.`` stops only at line terminators, and JS
``$`` (no m flag) is the end of input (Java ``$`` also matches before a
final newline), so patterns use ``\\z``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.functions.timeutil import col_of

# JS whitespace (\s, trim) and JS "." as explicit classes valid in Java and RE2.
JS_SPACE = r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
JS_NONSPACE = JS_SPACE.replace("[", "[^", 1)
JS_DOT = r"[^\n\r\x{2028}\x{2029}]"


def js(pattern: str) -> str:
    """Rewrite a JS regex body: \\s, \\S, '.', and '$' -> their JS meanings."""
    out, i = [], 0
    in_class = False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(JS_SPACE[1:-1] if in_class else JS_SPACE)
            elif nxt == "S" and not in_class:
                out.append(JS_NONSPACE)
            else:
                out.append(pattern[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "." and not in_class:
            out.append(JS_DOT)
            i += 1
            continue
        elif ch == "$" and not in_class:
            out.append(r"\z")
            i += 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


# The same whitespace set as characters, for btrim (no regex scan of the whole text).
JS_SPACE_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                  + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(c) -> Column:
    """JS String.prototype.trim (Spark's one-argument trim strips only ' ')."""
    return F.btrim(col_of(c), F.lit(JS_SPACE_CHARS))


# ---------------------------------------------------------------- E5 skip_reason

# The reference's skip patterns (JS syntax, i = case-insensitive).
THANK_PATTERNS = [
    ("^(ありがとう|有難う|感謝|サンクス|thanks|thank you)", "i"),
    ("^(了解|りょうかい|わかりました|承知|ok|オッケー)", "i"),
]
THANK_PATTERNS_EXTRA = [("^(助かり|たすかり)", "i")]  # Finance and General
INFO_PATTERNS_FINANCE = [
    (r"^[\d\-]{4,}$", ""),
    (r"^[\w\.\-]+@[\w\.\-]+\.[a-z]{2,}$", "i"),
    (r"^社員番号[はがを]?[:：\s]*[\d\-]+$", ""),
]
INFO_PATTERNS_GENERAL = INFO_PATTERNS_FINANCE + [
    (r"^(社員|従業員)?\s*(番号|No\.?|ナンバー)[はがを]?[:：\s]*[\d\-]+$", "i"),
    (r"^名前[はがを]?[:：\s]*.{1,20}$", ""),
    (r"^私[はが].{1,15}です$", ""),
    (r"^(メール|メアド|email)[はがを]?[:：\s]*[\w\.\-]+@[\w\.\-]+$", "i"),
    (r"^電話[はがを]?[:：\s]*[\d\-]+$", ""),
    (r"^ログインID[はがを]?[:：\s]*\S+$", "i"),
    (r"名前[はがをと].+[、,].*(ID|id|ユーザー|番号)", "i"),
    (r"(ID|id|ユーザー|番号)[はがをと]?.+[、,].*名前", "i"),
    (r"^.{2,10}[、,\s]+(ID|id)?[：:]?\s*[\d]{5,}$", ""),
]
SHORT_DATA_PATTERN = r"^[\d\w@\.\-]+$"
SHORT_DATA_MAX = 30
SKIP_VARIANTS = {
    "it": (THANK_PATTERNS, [], False),
    "hr": (THANK_PATTERNS, [], False),
    "finance": (THANK_PATTERNS + THANK_PATTERNS_EXTRA, INFO_PATTERNS_FINANCE, False),
    "general": (THANK_PATTERNS + THANK_PATTERNS_EXTRA, INFO_PATTERNS_GENERAL, True),
}


def java_regex(pattern: str, flags: str = "") -> str:
    return ("(?i)" if "i" in flags else "") + js(pattern)


# Literals an unanchored pattern cannot match without; checked first with a plain
# substring search, which skips the regex (and its backtracking) on long texts.
REQUIRED_LITERAL = {r"名前[はがをと].+[、,].*(ID|id|ユーザー|番号)": "名前",
                    r"(ID|id|ユーザー|番号)[はがをと]?.+[、,].*名前": "名前"}


def _match(c: Column, p: str, f: str) -> Column:
    hit = c.rlike(java_regex(p, f))
    lit = REQUIRED_LITERAL.get(p)
    return (c.contains(lit) & hit) if lit else hit


def _any_match(c: Column, patterns) -> Column:
    if not patterns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [_match(c, p, f) for p, f in patterns])


def skip_reason(message, variant: str = "general") -> Column:
    """E5: 'thank_you' / 'info_only' / 'short_data' / NULL for a chat message.

    Rules run in order on the JS-trimmed message of the queue ``variant``
    (it, hr, finance, general). "ok" is a bare prefix, as in the reference.
    """
    thanks, infos, short = SKIP_VARIANTS[variant]
    m = js_trim(F.coalesce(col_of(message), F.lit("")))
    out = F.when(_any_match(m, thanks), F.lit("thank_you"))
    if infos:
        out = out.when(_any_match(m, infos), F.lit("info_only"))
    if short:
        clean = js_trim(F.regexp_replace(m, r"[\n\r]", " "))
        out = out.when((F.char_length(clean) <= SHORT_DATA_MAX) & clean.rlike(js(SHORT_DATA_PATTERN)),
                       F.lit("short_data"))
    return out


# ---------------------------------------------------------------- E4, E6, E7, E8, E15

MENTION = r"<@[A-Z0-9]+>"


def strip_mentions(text) -> Column:
    """Drop <@USERID> mentions, then trim all Unicode whitespace (Python strip)."""
    return js_trim(F.regexp_replace(F.coalesce(col_of(text), F.lit("")), MENTION, ""))


MAX_VALUE_BYTES = 2000  # fixed value: button payload limit
SHORT_ESCAPED = '"\\\n\r\t\b\f'  # JSON escapes two bytes long
CONTROL_ESCAPED = "".join(chr(c) for c in [*range(0, 8), 11, *range(14, 32)])  # escaped as \\u00XX
VALUE_FIELDS = ["channel_id", "thread_ts", "user_id", "user_name", "message", "event_ts", "category"]


def fit_bytes(df: DataFrame, max_bytes: int = MAX_VALUE_BYTES, message_col: str = "message",
              fields: list[str] = VALUE_FIELDS, out: str = "value") -> DataFrame:
    """The button value JSON, halving the message until it fits in bytes.

    The reference recomputes ``json.dumps`` with ``msg[:len(msg)//2]`` until the
    UTF-8 size is at most ``max_bytes``. A candidate's size is computed without
    serializing it: the JSON of the other fields with an empty message, plus the
    prefix's UTF-8 bytes, plus one byte per short escape (quote, backslash,
    \\n \\r \\t \\b \\f) and five per other control character (\\u00XX).
    Every character takes at least one byte, so the candidates longer than the
    byte budget cannot fit; the first one that may (found from log2 of the
    length) and the next few halvings are measured as plain column
    expressions, and the first that fits is serialized. Work per row is
    bounded by the budget, not by the message length: the message length and
    the JSON overhead are projected once, before the candidates use them.
    """
    def as_json(m):
        parts = [m.alias(f) if f == message_col else F.col(f).alias(f) for f in fields]
        return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})

    x = df.withColumn("_fit_msg", F.coalesce(F.col(message_col), F.lit("")))
    x = x.withColumn("_fit_n", F.char_length("_fit_msg")).withColumn("_fit_empty", F.octet_length(as_json(F.lit(""))))
    n, empty, msg = F.col("_fit_n"), F.col("_fit_empty"), F.col("_fit_msg")
    budget = F.lit(max_bytes) - empty
    x = x.withColumn("_fit_start", F.when(n <= budget, F.lit(0)).otherwise(
        F.floor(F.log2(n / (F.greatest(budget, F.lit(0)) + 1))).cast("int")))

    def length(k):
        return F.floor(n / F.pow(F.lit(2.0), k)).cast("int")

    def fits(k):
        p = F.substring(msg, F.lit(1), length(k))
        short = F.char_length(p) - F.char_length(F.translate(p, SHORT_ESCAPED, ""))
        ctrl = F.char_length(p) - F.char_length(F.translate(p, CONTROL_ESCAPED, ""))
        size = empty + F.octet_length(p) + short + ctrl * 5
        return (k >= 0) & (length(k) <= budget) & (size <= max_bytes)

    ks = [F.col("_fit_start") + i for i in range(HALVINGS_MEASURED)]
    chosen = F.coalesce(*[F.when(fits(k), k) for k in ks], F.lit(63))  # 63: empty message
    x = x.withColumn("_fit_k", F.when(budget < 0, F.lit(63)).otherwise(chosen))
    x = x.withColumn(out, as_json(F.substring(msg, F.lit(1), length(F.col("_fit_k")))))
    return x.drop("_fit_msg", "_fit_n", "_fit_empty", "_fit_start", "_fit_k")


HALVINGS_MEASURED = 16  # from one below the first possible fit: covers 6-byte escapes of every char


def truncate(text, n: int) -> Column:
    """First n characters (code points; JS counts UTF-16 units)."""
    return F.substring(F.coalesce(col_of(text), F.lit("")), 1, n)


def escape_json_text(text, extra: bool = True) -> Column:
    """Escape backslash, quote, newline (and CR, TAB when ``extra``)."""
    c = F.regexp_replace(col_of(text), r"\\", r"\\\\")
    c = F.regexp_replace(c, '"', '\\\\"')
    c = F.regexp_replace(c, "\n", "\\\\n")
    if extra:
        c = F.regexp_replace(F.regexp_replace(c, "\r", "\\\\r"), "\t", "\\\\t")
    return c


def similarity_pct(score) -> Column:
    """Math.round(similarity * 100) (half rounds up)."""
    return F.floor(col_of(score) * F.lit(100.0) + F.lit(0.5)).cast("long")


# ---------------------------------------------------------------- E11, E12, F9, F10, P5, P6, S9

def _truthy(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def parse_feedback(value_col: str = "value") -> list[Column]:
    """log_id, ticket_id, category from the button value JSON, falling back
    to the body fields; category defaults to 'it'; thread and comment to ''.

    Malformed JSON takes the body fields (the reference's catch branch).
    """
    v = F.coalesce(F.col(value_col), F.lit("{}"))
    parsed = F.from_json(v, "log_id string, ticket_id string, category string")
    bad = F.try_parse_json(v).isNull()
    body = {c: F.col(c) for c in ("log_id", "ticket_id", "category")}
    val = {c: F.when(~bad, parsed[c]).otherwise(body[c]) for c in body}
    val["category"] = F.when(~bad, parsed["category"]).otherwise(
        F.coalesce(_truthy(body["category"]), F.lit("it")))
    return [
        F.coalesce(_truthy(val["log_id"]), _truthy(body["log_id"])).alias("log_id"),
        F.coalesce(_truthy(val["ticket_id"]), _truthy(body["ticket_id"])).alias("ticket_id"),
        F.coalesce(_truthy(val["category"]), _truthy(body["category"]), F.lit("it")).alias("category"),
        F.coalesce(_truthy(F.col("thread_ts")), F.lit("")).alias("thread_ts"),
        F.coalesce(_truthy(F.col("comment")), F.lit("")).alias("comment"),
    ]


def split_tags(tags) -> Column:
    """Comma split with each element trimmed (JS trim); empty elements stay."""
    return F.transform(F.split(F.coalesce(col_of(tags), F.lit("")), ","), js_trim)


def route_messages(retry_col: str = "retry_num") -> Column:
    """route of an inbound chat event.

    retries -> 'drop'; app mentions -> 'selection', whoever sent them; other
    bot messages and any subtype -> 'drop'; direct messages -> 'selection'; thread replies (thread_ts set and !=
    ts) -> 'process'; everything else -> 'drop'.
    """
    def has(c):
        return F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return (F.when(has(retry_col), "drop").when(F.col("type") == "app_mention", "selection")
            .when(has("bot_id"), "drop").when(has("subtype"), "drop")
            .when(F.col("channel_type") == "im", "selection")
            .when(has("thread_ts") & (F.col("thread_ts") != F.coalesce(F.col("ts"), F.lit(""))), "process")
            .otherwise("drop"))


CONFIDENCE_GATE = 0.6  # fixed value


def confidence_gate(can_resolve, confidence, threshold=None, requires_escalation=None) -> Column:
    """answer directly when can_resolve and confidence >= 0.6 (or the
    article's own threshold, when joined), unless the article requires
    escalation; else ticket + escalation."""
    th = F.coalesce(col_of(threshold), F.lit(CONFIDENCE_GATE)) if threshold is not None else F.lit(CONFIDENCE_GATE)
    ok = F.coalesce(col_of(can_resolve), F.lit(False)) & (F.coalesce(col_of(confidence), F.lit(0.0)) >= th)
    if requires_escalation is not None:
        ok = ok & ~F.coalesce(col_of(requires_escalation), F.lit(False))
    return F.when(ok, F.lit("answer")).otherwise(F.lit("escalate"))


# Labels of the search-text concatenations.
ASSET_TEXT_LABELS = ["アセットID: ", "タイプ: ", "デバイス名: ", "メーカー: ", "モデル: ", "担当者: ",
                     "部署: ", "場所: ", "備考: "]
UNASSIGNED, UNKNOWN = "未割当", "不明"
KB_TEXT_LABELS = ["質問: ", "カテゴリ: ", "回答: ", "キーワード: "]


def asset_search_text() -> Column:
    """P5 (assets): labelled concat; NULL asset_id or asset_type nulls the text (SQL CONCAT)."""
    L, e = ASSET_TEXT_LABELS, F.lit("")

    def cz(c, d=""):
        return F.coalesce(F.col(c), F.lit(d))
    return F.concat(F.lit(L[0]), F.col("asset_id"), F.lit(" "), F.lit(L[1]), F.col("asset_type"), F.lit(" "),
                    F.lit(L[2]), cz("asset_name"), F.lit(" "), F.lit(L[3]), cz("manufacturer"), F.lit(" "),
                    F.lit(L[4]), cz("model"), F.lit(" "), F.lit(L[5]), cz("assigned_to", UNASSIGNED), F.lit(" "),
                    F.lit(L[6]), cz("department", UNKNOWN), F.lit(" "), F.lit(L[7]), cz("location", UNKNOWN),
                    F.lit(" "), F.lit(L[8]), cz("notes"), e)


def kb_search_text() -> Column:
    """P5 (knowledge): question, category, subcategory, answer, keywords."""
    L = KB_TEXT_LABELS
    return F.concat(F.lit(L[0]), F.col("question"), F.lit(" "), F.lit(L[1]), F.col("category"), F.lit(" "),
                    F.coalesce(F.col("subcategory"), F.lit("")), F.lit(" "), F.lit(L[2]), F.col("answer"),
                    F.lit(" "), F.lit(L[3]), F.coalesce(F.col("keywords"), F.lit("")))


def typed_setting(value_col: str = "setting_value", type_col: str = "setting_type") -> Column:
    """A setting's typed value as a struct(kind, number, flag, text).

    number: parseInt -> leading integer ('12abc' -> 12), blank/NULL -> 0,
    no digits -> NULL (NaN); boolean: equals 'true'; string: '' for NULL.
    """
    v = F.col(value_col)
    t = F.col(type_col)
    digits = F.regexp_extract(F.coalesce(F.nullif(v, F.lit("")), F.lit("0")), f"^{JS_SPACE}*([+-]?\\d+)", 1)
    number = F.when(t == "number", F.nullif(digits, F.lit("")).try_cast("long"))
    flag = F.when(t == "boolean", F.coalesce(v == "true", F.lit(False)))
    text = F.when(~t.isin("number", "boolean") | t.isNull(), F.coalesce(v, F.lit("")))
    return F.struct(t.alias("kind"), number.alias("number"), flag.alias("flag"), text.alias("text"))


# Section headers of a flattened FAQ article.
ANSWER_HEADER = "【回答】"
STEPS_HEADER = "【解決手順】"
FAQ_AUTHOR = "ヘルプデスク"


def flatten_knowledge_columns() -> list[Column]:
    """FAQ record -> article columns (title, content, category, tags, author).

    Steps come as a JSON array text (or NULL); they are joined by newlines.
    """
    steps = F.coalesce(F.from_json(F.col("resolution_steps"), "array<string>"), F.array().cast("array<string>"))
    content = F.concat(F.lit(ANSWER_HEADER + "\n"), F.coalesce(F.col("answer"), F.lit("")),
                       F.lit("\n\n" + STEPS_HEADER + "\n"), F.array_join(steps, "\n"))
    return [F.col("question").alias("title"), content.alias("content"), F.col("category"),
            F.col("keywords").alias("tags"), F.lit(FAQ_AUTHOR).alias("author")]


# ---------------------------------------------------------------- E16 triage (re-aimed)

# Fixed values chosen for the re-aimed keyword triage (the reference delegates to a model
# prompt whose criteria are: HIGH = work stopped / many people / security, MEDIUM =
# partial with workaround, LOW = minor or question).
TRIAGE_URGENCY = {
    "HIGH": ["業務停止", "全員", "複数", "セキュリティ", "ウイルス", "情報漏", "緊急", "urgent", "outage",
             "security", "breach", "virus", "everyone", "down"],
    "MEDIUM": ["一部", "代替", "遅い", "workaround", "partial", "slow", "intermittent"],
}
TRIAGE_CATEGORY = {
    "HARDWARE": ["pc", "パソコン", "プリンター", "スキャナー", "printer", "scanner", "laptop", "monitor", "device"],
    "SOFTWARE": ["vpn", "ソフト", "アプリ", "software", "install", "excel", "update", "app"],
    "ACCOUNT": ["パスワード", "アカウント", "ログイン", "password", "account", "login"],
}
SUMMARY_MAX = 50


def _kw_regex(words) -> str:
    """Latin keywords match whole words only; Japanese ones, written without
    spaces, match anywhere."""
    import re
    return "(?i)(" + "|".join(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])" if w.isascii() else re.escape(w) for w in words) + ")"


def triage(message) -> list[Column]:
    """E16 (re-aimed): urgency and category from keyword tables, a summary of at
    most 50 characters, and the details split on sentence ends / newlines.

    Order matters: HIGH is checked before MEDIUM, categories in table order.
    """
    m = js_trim(F.coalesce(col_of(message), F.lit("")))
    urg = F.when(m.rlike(_kw_regex(TRIAGE_URGENCY["HIGH"])), "HIGH") \
           .when(m.rlike(_kw_regex(TRIAGE_URGENCY["MEDIUM"])), "MEDIUM").otherwise("LOW")
    cat = None
    for k, words in TRIAGE_CATEGORY.items():
        cond = m.rlike(_kw_regex(words))
        cat = F.when(cond, k) if cat is None else cat.when(cond, k)
    details = F.filter(F.transform(F.split(m, r"[。\n]|\. "), js_trim), lambda s: s != "")
    return [urg.alias("urgency"), cat.otherwise("OTHER").alias("category"),
            F.substring(m, 1, SUMMARY_MAX).alias("summary"), details.alias("details")]
