"""Hand-made edge rows for the message/text functions (FIXTURES.md section 3)."""

import json

from pyspark.sql import functions as F

from ticketflow.functions import agent, text


def _one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


def test_skip_reason_rules(spark):
    msgs = [
        ("　thanks a lot　",),   # U+3000 around the text is trimmed like JS trim
        ("okay, but the VPN is down",),  # 'ok' is a bare prefix: skipped
        ("了解しました",),
        ("12345-678",),
        ("foo@example.com\n",),          # trailing newline: trimmed, then info
        ("社員番号は: 1234",),
        ("私は田中です",),
        ("abc_123",),                    # short data (General only)
        ("プリンターが動きません。助けてください",),
        (None,),
        ("助かりました",),
    ]
    rows = _one(spark, msgs, "m string", text.skip_reason("m", "general").alias("g"),
                text.skip_reason("m", "finance").alias("f"), text.skip_reason("m", "it").alias("i"))
    got = [(r.g, r.f, r.i) for r in rows]
    assert got[0] == ("thank_you",) * 3
    assert got[1] == ("thank_you",) * 3
    assert got[2] == ("thank_you",) * 3
    assert got[3] == ("info_only", "info_only", None)
    assert got[4] == ("info_only", "info_only", None)
    assert got[5] == ("info_only", "info_only", None)
    assert got[6] == ("info_only", None, None)
    assert got[7] == ("short_data", None, None)
    assert got[8] == (None, None, None)
    assert got[9] == (None, None, None)
    assert got[10] == ("thank_you", "thank_you", None)


def test_js_dollar_is_end_of_input(spark):
    # Java '$' would match before a final newline; the JS rule must not
    rows = _one(spark, [("1234\nx",)], "m string", F.col("m").rlike(text.js(r"^[\d\-]{4,}$")).alias("hit"))
    assert rows[0].hit is False


def test_strip_mentions_and_fit_bytes(spark):
    big = "あ" * 3000  # 9000 UTF-8 bytes: must be halved until the JSON fits
    df = spark.createDataFrame(
        [("C1", None, "U1", "name", "<@U12AB> " + big, "1", "it"), ("C1", "t", "U1", None, "  hi <@X9>  ", "2", "hr")],
        "channel_id string, thread_ts string, user_id string, user_name string, message string, "
        "event_ts string, category string")
    out = text.fit_bytes(df.withColumn("message", text.strip_mentions("message")), out="v").select("v").collect()
    v0 = json.loads(out[0].v)
    assert len(out[0].v.encode("utf-8")) <= 2000
    n = 3000
    while len(json.dumps({**v0, "message": big[:n]}, ensure_ascii=False, separators=(",", ":")).encode()) > 2000:
        n //= 2
    assert v0["message"] == big[:n] and v0["thread_ts"] is None
    assert json.loads(out[1].v)["message"] == "hi"


def test_parse_feedback_fallbacks(spark):
    rows = [
        ('{"log_id": 7, "ticket_id": "IT-1", "category": "hr"}', "9", None, None, "t1", None),
        ("{not json", "9", "T-9", None, "", "c"),
        (None, "5", None, "finance", None, None),
        ('{"log_id": "", "category": ""}', "4", "X-4", "", None, None),
    ]
    df = spark.createDataFrame(rows, "value string, log_id string, ticket_id string, category string, "
                                     "thread_ts string, comment string")
    got = [tuple(r) for r in df.select(*text.parse_feedback()).collect()]
    assert got[0] == ("7", "IT-1", "hr", "t1", "")
    assert got[1] == ("9", "T-9", "it", "", "c")
    assert got[2] == ("5", None, "finance", "", "")
    assert got[3] == ("4", "X-4", "it", "", "")


def test_route_messages(spark):
    rows = [
        ("1", "message", None, None, "im", None, "1.0", None),
        ("2", "message", None, "B1", "im", None, "2.0", None),
        ("3", "message", "message_changed", None, "channel", "1.0", "3.0", None),
        ("4", "message", None, None, "channel", "1.0", "4.0", None),
        ("5", "message", None, None, "channel", "5.0", "5.0", None),
        ("6", "app_mention", None, None, "channel", None, "6.0", None),
        ("7", "message", None, None, "channel", "1.0", "7.0", 1),
    ]
    df = spark.createDataFrame(rows, "event_id string, type string, subtype string, bot_id string, "
                                     "channel_type string, thread_ts string, ts string, retry_num int")
    got = [r.route for r in df.select(text.route_messages().alias("route")).collect()]
    assert got == ["selection", "drop", "drop", "process", "drop", "selection", "drop"]


def test_typed_settings(spark):
    rows = [("number", "12abc"), ("number", ""), ("number", None), ("number", "x1"), ("boolean", "true"),
            ("boolean", "TRUE"), ("string", None), ("string", "v")]
    df = spark.createDataFrame(rows, "setting_type string, setting_value string")
    got = [tuple(r.t) for r in df.select(text.typed_setting().alias("t")).collect()]
    assert got[0] == ("number", 12, None, None)
    assert got[1] == ("number", 0, None, None)
    assert got[2] == ("number", 0, None, None)
    assert got[3] == ("number", None, None, None)   # parseInt('x1') is NaN
    assert got[4][2] is True and got[5][2] is False
    assert got[6] == ("string", None, None, "") and got[7][3] == "v"


def test_agent_response_variants(spark):
    fenced = {"content": [{"type": "text", "text": 'hi\n```json\n{"category": "HARDWARE", "needsEscalation": true, '
                                                    '"escalationTeam": "NET", "resolutionSteps": ["a", "b"]}\n```\n- done'},
                          {"type": "tool_result", "tool_result": {"content": [{"json": {"search_results": [
                              {"kb_id": "KB1", "@CONFIDENCE_SCORE": "0.81x", "question": "q" * 150},
                              {"id": "", "kb_id": "", "columns": {"@CONFIDENCE_SCORE": "0.2"}}]}}]}}],
              "metadata": {"usage": {"tokens_consumed": [{"input_tokens": {"total": 11},
                                                          "output_tokens": {"total": 5}, "model_name": "m"}]}}}
    raw = {"content": [{"type": "text", "text": 'answer {"response": "x", "priority": "LOW"} end'}]}
    broken_team = {"content": [{"type": "text", "text": '```json\n{bad\n``` and {"escalation_team": oops}'}]}
    rows = [(json.dumps(fenced),), (json.dumps(raw),), ("not json",), (json.dumps(broken_team),), (None,), ("null",)]
    df = agent.parse_agent_response(spark.createDataFrame(rows, "response string"))
    r = df.collect()
    assert (r[0].category, r[0].priority, r[0].needs_escalation, r[0].escalation_team) == ("HARDWARE", "MEDIUM", True, "NET")
    assert r[0].ai_response_text == "done" and r[0].resolution_steps == ["a", "b"]
    assert r[0].matched_kb_ids == "KB1" and abs(r[0].confidence_scores[0].score - 0.81) < 1e-12
    assert len(r[0].confidence_scores[0].text) == 100 and r[0].confidence_scores[1].id is None
    assert (r[0].tokens_input, r[0].tokens_output, r[0].model_name) == (11, 5, "m")
    assert (r[1].category, r[1].priority, r[1].summary) == ("OTHER", "LOW", "問い合わせ内容")
    assert r[1].ai_response_text == 'answer {"response": "x", "priority": "LOW"} end'
    assert r[2].category == "ERROR" and r[2].escalation_team == "IT_SUPPORT" and r[2].parse_error
    assert r[3].category == "ERROR"      # raw fallback after a broken fenced block is invalid JSON
    assert r[4].category == "OTHER" and r[4].ai_response_text == ""
    assert r[5].category == "ERROR"      # JSON null: the reference throws on property access
    it = agent.parse_agent_response(spark.createDataFrame([(json.dumps(fenced), "m" * 120)], "response string, msg string"),
                                    message="msg", variant="it").collect()[0]
    assert (it.category, it.priority, len(it.summary), it.ai_response_text) == ("IT", "MEDIUM", 100, "done")


def test_split_tags_and_similarity_pct(spark):
    df = spark.createDataFrame([(" a, b ,,　c ", 0.125), (None, 0.005)], "tags string, s double")
    r = df.select(text.split_tags("tags").alias("t"), text.similarity_pct("s").alias("p")).collect()
    assert r[0].t == ["a", "b", "", "c"] and r[1].t == [""]
    assert (r[0].p, r[1].p) == (13, 1)


def test_escape_json_text_and_truncate(spark):
    s = 'a\\b"c\nd\re\tf'
    r = _one(spark, [(s,)], "t string", text.escape_json_text("t").alias("e"),
             text.escape_json_text("t", extra=False).alias("e2"), text.truncate("t", 3).alias("c"))[0]
    assert r.e == 'a\\\\b\\"c\\nd\\re\\tf'
    assert r.e2 == 'a\\\\b\\"c\\nd\re\tf'
    assert r.c == 'a\\b'
