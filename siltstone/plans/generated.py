"""Queries over text: generated answers, papers, prompts and recognised pages, one made for each order.

A text is put together from an order's key by an expression that both engines read; its SQL gives what the operator
should find from the key alone, without looking at the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..operators import answers, dispatch, search, spatial, structure, tables, validate
from .common import Registry, dealt, table

REGISTRY = Registry()
add = REGISTRY.add
NL = "chr(10)"


def pick(of: str, *values: str) -> str:
    """An expression: the value at `of` modulo their number; null where one is None."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None)
    return f"(CASE ({of}) % {len(values)} {cases} END)"


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def pick_text(of: str, *values: str | None) -> str:
    return pick(of, *(None if v is None else quote(v) for v in values))


def made(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """A row for each order: k, and columns given as expressions of it."""
    return _of_keys(table(spark, sf_dir, "orders"), columns)


def made_long(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """made() for texts that take long to read: the keys of a single file are dealt to all cores first."""
    return _of_keys(dealt(spark, sf_dir, "orders", "o_orderkey"), columns)


def _of_keys(orders: DataFrame, columns: dict[str, str]) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("k")).select("k", *(F.expr(x).alias(c) for c, x in columns.items()))


K = "(SELECT o_orderkey AS k FROM orders)"

# answers

LABEL = {q: pick(f"k + {q}", "'A'", "'B'", "'TRUE'", "'NOT GIVEN'", "'old wine ' || k") for q in (11, 12, 13)}
EVIDENCE = {q: f"'vintage ' || k || ' is number {q}'" for q in LABEL}
RELATION = {q: pick_text(f"k + {q}", "supports", "contradicts", "absent", None) for q in LABEL}


def _answer(q: int, label: str) -> str:
    forms = (
        f"'Question {q}: **' || {label} || '** - Evidence: none' || {NL} || 'Evidence: \"' || {EVIDENCE[q]} || '\"'",
        f"'{q}. Answer: ' || {label} || {NL} || '- **Bằng chứng: ' || {EVIDENCE[q]}",
        f"'  câu hỏi {q}) ' || {label} || ' giải thích: x' || {NL} || 'Evidence: ' || {EVIDENCE[q]}",
    )
    return f"({pick(f'k + {q}', *forms)} || CASE WHEN {RELATION[q]} IS NULL THEN '' ELSE {NL} || 'Relationship: ' || {RELATION[q]} END)"


def _answers(labels: dict[int, str]) -> str:
    """Numbers 11 to 13; each seventh text lacks the last."""
    return f"{_answer(11, labels[11])} || {NL} || {NL} || {_answer(12, labels[12])} || CASE WHEN k % 7 = 0 THEN '' ELSE {NL} || {_answer(13, labels[13])} END"


def _segments(spark: SparkSession, sf_dir: str, labels: dict[int, str]) -> DataFrame:
    return answers.segments(made(spark, sf_dir, text=_answers(labels), numbers="array(11, 12, 13)"), "k", "text", "numbers")


def _each(select: str) -> str:
    """UNION over the numbers of a SELECT with {q}, {label}, {evidence}, {relation}."""
    return " UNION ALL ".join(f"SELECT {select.format(q=q, label=LABEL[q], evidence=EVIDENCE[q], relation=RELATION[q])} FROM {K}" for q in LABEL)


@add(f"""SELECT k, number, CASE WHEN gone THEN '' ELSE head END AS head, CASE WHEN gone THEN '' ELSE evidence END AS evidence, CASE WHEN NOT gone THEN relationship END AS relationship
    FROM (SELECT *, number = 13 AND k % 7 = 0 AS gone FROM ({_each('k, {q} AS number, {label} AS head, {evidence} AS evidence, {relation} AS relationship')}))""")
def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("segment")
    return _segments(spark, sf_dir, LABEL).select("k", "number", answers.head(s, F.col("number")).alias("head"), answers.evidence(s).alias("evidence"), answers.relationship(s).alias("relationship"))


_SOLD = {11: "'unsure'", 12: pick("k", "'It is sold young, ' || k", "'Kept'", "'sold young or kept'", "'neither'"), 13: "'word'"}


@add(f"""SELECT k, 11 AS number, {pick_text('k + 11', 'TRUE', 'FALSE', 'NOT GIVEN', None)} AS answer FROM {K}
    UNION ALL SELECT k, 12, {pick_text('k', 'C', 'D', None, None)} FROM {K} UNION ALL SELECT k, 13, NULL FROM {K}""")
def answer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("number")
    kind = F.when(n == 11, "true_false_not_given").when(n == 12, "multiple_choice").otherwise("short_answer")
    options = F.array(F.struct(F.lit("C").alias("label"), F.lit("Sold young").alias("text")), F.struct(F.lit("D").alias("label"), F.lit("kept").alias("text")))
    return _segments(spark, sf_dir, _SOLD).select("k", "number", answers.normalised_answer(kind, F.col("segment"), n, options).alias("answer"))


_PACKETS = "array(named_struct('number', 11, 'kind', 'true_false_not_given', 'options', array(named_struct('label', 'Z', 'text', ''))), named_struct('number', 12, 'kind', 'multiple_choice', 'options', array(named_struct('label', 'C', 'text', 'Sold young'), named_struct('label', 'D', 'text', 'kept'))))"
_TWO = "'11. ' || {a} || chr(10) || 'Relationship: ' || {r} || chr(10) || '12. ' || {b} || chr(10) || 'Relationship: supports'"
_MAPPED = pick_text("k", "TRUE", "FALSE", "NOT GIVEN")
_CHOSEN = pick_text("k", "C", "D", "sold young or kept", "neither")


@add(f"SELECT k, {_TWO.format(a=_MAPPED, r=pick_text('k', 'supports', 'contradicts', 'absent'), b=_CHOSEN)} AS text, CAST(1 + CASE WHEN k % 4 < 2 THEN 1 ELSE 0 END AS INTEGER) AS adjusted FROM {K}")
def answer_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _TWO.format(a="'maybe ' || k", r=pick_text("k", "supports", "contradicts", "absent"), b=_SOLD[12])
    out = answers.normalise_output(made_long(spark, sf_dir, text=said, packets=_PACKETS))
    return out.select("k", "text", F.size("adjustments").alias("adjusted"))


@add(f"""SELECT k, array_to_string(list_filter([
      CASE k % 6 WHEN 0 THEN 'Question 7 is missing a valid answer option label.' WHEN 3 THEN 'Question 7 is missing a valid answer option label.' END,
      CASE WHEN k % 6 IN (1, 3) THEN 'Question 7 is missing an Evidence field.' END,
      CASE WHEN k % 6 IN (2, 3) THEN 'Question 7 is missing a valid Relationship field.' WHEN k % 6 = 4 THEN 'Question 7 must use Relationship: supports for the selected answer.' END,
      CASE WHEN k % 6 = 5 THEN 'Question 7 Evidence is not quoted from its selected passage evidence.' END], lambda x: x IS NOT NULL), '|') AS issues FROM {K}""")
def answer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"'7. ' || {pick_text('k', 'wine', 'A', 'b', 'A or B', 'B', 'A')} || CASE WHEN k % 6 IN (1, 3) THEN '' ELSE {NL} || 'Evidence: wine is old ' || k END || CASE WHEN k % 6 IN (2, 3) THEN '' ELSE {NL} || 'Relationship: ' || CASE WHEN k % 6 = 4 THEN 'contradicts' ELSE 'supports' END END"
    rows = made(spark, sf_dir, text=said, source="'In short: wine is old ' || CASE WHEN k % 6 = 5 THEN k + 1 ELSE k END || ' indeed'")
    s, n = F.col("text"), F.lit(7)
    contained = F.contains(validate.normalized_evidence(F.col("source")), validate.normalized_evidence(answers.evidence(s)))
    found = answers.answer_issues(F.lit("multiple_choice"), s, n, F.array(F.lit("A"), F.lit("B")), F.lit(None).cast("int"), F.lit(True), contained)
    return rows.select("k", F.array_join(found, "|").alias("issues"))


@add(f"""SELECT k, array_to_string(list_filter(['A', 'B', 'C', 'D'], lambda x: CASE x WHEN 'A' THEN k % 2 = 1 WHEN 'B' THEN k // 2 % 2 = 1 WHEN 'C' THEN k // 4 % 2 = 1 ELSE k // 8 % 2 = 1 END), ',') AS labels FROM {K}""")
def answer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = " || ".join(f"CASE WHEN (k div {2**i}) % 2 = 1 THEN '{x} and ' ELSE '' END" for i, x in reversed(list(enumerate("ABCD"))))
    rows = made(spark, sf_dir, answer=f"'Both ' || {parts} || 'nothing else'", allowed="array('A', 'B', 'C', 'D')")
    return rows.select("k", F.array_join(F.array_sort(answers.selected_labels(F.col("answer"), F.col("allowed"))), ",").alias("labels"))


@add(f"""SELECT k, {pick('k', "'[Source 2: b] 3. x' || k || ' 4. y'", "'[Source 1: a] Questions 3-4 ' || k", "'[Source 1: a] none ' || k || chr(10) || chr(10) || '[Source 2: b] nor here'")} AS block FROM {K}""")
def focused_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = pick("k", "array('[Source 1: a] 3. x', '[Source 2: b] 3. x' || k || ' 4. y', '[source 2: B]  3. X' || k || ' 4. y')", "array('[Source 1: a] Questions 3-4 ' || k, '[Source 9: c] questions 3 to 4, and a longer text ' || k)", "array('[Source 1: a] none ' || k, '[Source 2: b] nor here', '[Source 1: A] None ' || k)")
    rows = made(spark, sf_dir, blocks=blocks).select("k", F.posexplode("blocks").alias("p", "block"))
    return answers.focused_source(rows, "k", "block", "p", [3, 4])


@add(f"SELECT k, {pick('k', 'NULL', chr(39) + 'Wine is old ' + chr(39) + ' || k || ' + chr(39) + '. ' + chr(39), chr(39) + 'Wine is old ' + chr(39) + ' || k || ' + chr(39) + '. AB Cd' + chr(39))} AS scope FROM {K}")
def paragraph_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick("k", "'A Rivers run ' || k", "'A Rivers run. B Wine is old ' || k || '. C Last one.'", "'A Rivers run. B Wine is old ' || k || '. AB Cd'")
    return made(spark, sf_dir, text=said).select("k", answers.paragraph_scope(F.col("text"), "B").alias("scope"))


_CHARTS = ("pie chart", "bar chart", "table", "map", "graph")


@add(f"""SELECT k, 1 AS task_number, 'The ' || {pick_text('k', *_CHARTS)} || ' below shows visitors of place ' || k || ' by age.' AS text, {pick_text('k', 'pie_chart', 'bar_chart', 'table', 'map', 'graph')} AS visual_type FROM {K}
    UNION ALL SELECT k, 2, 'Write an essay about cities and towns of ' || k || '.', NULL FROM {K}""")
def embedded_writing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"'intro' || {NL} || 'Writing Task 1: The ' || {pick_text('k', *_CHARTS)} || ' below' || {NL} || {NL} || '[Page 3]' || {NL} || 'shows visitors of place ' || k || ' by age.' || {NL} || '  Task 2' || {NL} || 'Write an essay about cities' || {NL} || 'and towns of ' || k || '. Page 4' || {NL} || 'Task 1 short'"
    return answers.writing_tasks(made(spark, sf_dir, text=said), "k", "text").select("k", "task_number", "text", "visual_type")


@add(f"SELECT k, 'Vintage wines of ' || k || ' are Name it' AS query FROM {K}")
def evidence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, stems="array('11. Vintage wines of ' || k || ' are A red B white', '12) Name it', '13. Name it', '14. ')").select("k", F.posexplode("stems").alias("p", "text"))
    return answers.evidence_query(rows, "k", "text", "p")


@add("""SELECT conv_id, turn, sha256(CASE WHEN p IS NULL THEN text ELSE p || chr(10) || text END) AS query_sha256 FROM (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations) WHERE role = 'user'""")
def follow_up_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.expand_query(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.sha2("query", 256).alias("query_sha256"))


# responses

_SAID = (
    f"'<think>hm ' || k || '</think>Assistant: Hello<br>there ' || k || {NL} || {NL} || {NL} || {NL} || 'End [Source 1: a.pdf]  '",
    f"'| a | b |' || {NL} || '|---|---|' || {NL} || '| x' || k || '<br>- y | c |' || {NL} || '| d | e' || {NL} || '- f |' || {NL} || '☀️ end'",
    "'## **User:** hi ' || k",
    "'The answer is B, ' || k",
    f"'so' || {NL} || (k % 90 + 1) || '. B'",
    "'phương án nào? không thể là c ' || k",
    f"'câu ' || (k % 90 + 1) || ': rất dài, không đủ thông tin'",
    f"(k % 90 + 1) || ' is an age, and ' || k || ' a year'",
)
_CLEAN = (
    f"'Hello' || {NL} || 'there ' || k || {NL} || {NL} || 'End a.pdf'",
    f"'| a | b |' || {NL} || '|---|---|' || {NL} || '| x' || k || '; y | c |' || {NL} || '| d | e; f |' || {NL} || 'end'",
    "'hi ' || k",
    *_SAID[3:],
)


@add(f"SELECT k, {pick('k', *_CLEAN)} AS cleaned, k % 8 IN (3, 4, 5, 6) AS leaks, {pick_text('k', None, None, 'user', None, None, None, None, None)} AS role FROM {K}")
def response_cleaner(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return made(spark, sf_dir, text=pick("k", *_SAID)).select("k", validate.clean_response(text).alias("cleaned"), validate.leaks_solution(text).alias("leaks"), validate.role_prefix(text).alias("role"))


_VIETNAMESE = ("'Những câu hỏi của tôi ' || k || ' là gì'", "'An answer to which question? NO MORE THAN TWO WORDS ' || k", "'Xin dịch file bài-' || k || '.pdf và Questions 3 - 5, where TRUE or NOT GIVEN'", "'1234 ' || k")


@add(f"""SELECT k, {pick('k', '6 * 2 + 7', '0', '3 * 2 + 2', '0')} AS vietnamese, {pick('k', '0', '3 * 2', '1 * 2', '0')} AS english, {pick('k', '7', '5', '6', '0')} AS tokens,
    {pick('k', '0', '6', '0', '3')} AS not_vietnamese, {pick('k', '19', '0', '0', '0')} AS not_english, {pick_text('k', 'Vietnamese', 'English', 'Vietnamese', 'Vietnamese')} AS language FROM {K}""")
def language_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, text=pick("k", *_VIETNAMESE))
    t = F.col("text")
    return rows.select("k", validate.language_evidence(t).alias("e"), validate.mismatch(t, "Vietnamese").alias("not_vietnamese"), validate.mismatch(t, "English").alias("not_english"), validate.conversation_language(t).alias("language")).select("k", "e.vietnamese", "e.english", "e.tokens", "not_vietnamese", "not_english", "language")


_TABLES = (
    f"'| a | b |' || {NL} || '| --- | --- |' || {NL} || '| ' || k || ' | 2 |'",
    f"'| a | b |' || {NL} || '| ' || k || ' | 2 |'",
    "'text only ' || k",
    f"'| a | b |' || {NL} || '|---|---|' || {NL} || '| ' || k || ' | 2 | 3 |'",
    f"'| a | b' || {NL} || '| --- | --- |'",
    f"'| a {chr(92)}{chr(92)}| x | b |' || {NL} || '| :--- | ---: |' || {NL} || '| ' || k || ' | 2 |'",
    f"'| a | b |' || {NL} || '|---|---|' || {NL} || {NL} || '| c |' || {NL} || '|---|'",
)


@add(f"SELECT k, k % 7 IN (1, 3, 4, 6) AS malformed FROM {K}")
def markdown_table_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, text=pick("k", *_TABLES)).select("k", validate.has_malformed_table(F.col("text")).alias("malformed"))


@add(f"""SELECT k, array_to_string(list_transform(list_filter([1, 2, 3, 4], lambda w: CASE k % 3 WHEN 0 THEN NOT (w <= 1 + k % 4 OR w = 4) WHEN 1 THEN w <> 1 + k % 6 ELSE true END), lambda w: CAST(w AS VARCHAR)), ',') AS missing, k % 3 = 1 AND 1 + k % 6 > 4 AS exceeds FROM {K}""")
def plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick("k", f"'| Week | Task |' || {NL} || '| --- | --- |' || {NL} || '| 1-' || (1 + k % 4) || ' | read |' || {NL} || '| 4 | rest |'", f"'| Tuần | Việc |' || {NL} || '|---|---|' || {NL} || '| tuần ' || (1 + k % 6) || ' | a |'", "'none ' || k")
    found = validate.plan_gaps(made(spark, sf_dir, text=said), "k", "text", 1, "month")
    return found.select("k", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "exceeds")


_ISSUE = {"role": "The response starts with a conversation role prefix.", "numbers": "The response is missing question numbers: [", "vietnamese": "The response is not written in Vietnamese."}


@add(f"""SELECT k, array_to_string(list_filter([CASE WHEN k % 5 = 3 THEN {quote(_ISSUE['role'])} END, CASE WHEN k % 5 = 4 THEN {quote(_ISSUE['vietnamese'])} END,
      CASE k % 5 WHEN 1 THEN {quote(_ISSUE['numbers'] + '4].')} WHEN 2 THEN {quote(_ISSUE['numbers'] + '3, 4, 5].')} WHEN 3 THEN {quote(_ISSUE['numbers'] + '3, 5].')} END], lambda x: x IS NOT NULL), '|') AS issues FROM {K}""")
def response_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import contracts

    own = contracts.response_contract("Dịch câu 3 đến 5 sang tiếng Việt", "translate_questions", allow_solution=True)
    line = lambda n: f"'{n}. Những câu hỏi của chúng tôi là gì? ' || k"
    said = pick("k", f"{line(3)} || {NL} || {line(4)} || {NL} || {line(5)}", f"{line(3)} || {NL} || '- **câu 5)** và là của ' || k", "'Những câu này của tôi không có số ' || k", f"'Assistant: là của tôi' || {NL} || {line(4)}", f"'3. What is the answer to this?' || {NL} || '4. Which words are they?' || {NL} || '5. Who did it and when? ' || k")
    return made(spark, sf_dir, text=said).select("k", F.array_join(contracts.issues(F.col("text"), own), "|").alias("issues"))


@add(f"SELECT DISTINCT k // 4 AS g, CAST(min(CASE WHEN k % 4 = 3 THEN 9 ELSE k % 4 END) AS INTEGER) AS best FROM {K} WHERE k % 4 > 0 GROUP BY k // 4")
def best_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of up to three candidates of a key, the second has all numbers, the third a table that is broken."""
    from ..operators import contracts

    own = contracts.response_contract("translate questions 1-2 to Vietnamese", "translate_questions", allow_solution=True)
    line = lambda n: f"'{n}. Những câu hỏi của chúng tôi là gì? ' || k"
    said = pick("k", "''", f"{line(1)} || {NL} || {line(2)}", f"{line(1)} || {NL} || {line(2)}", f"{line(1)} || {NL} || {line(2)} || {NL} || '| a |'")
    rows = made(spark, sf_dir, text=said, g="k div 4", o="cast(CASE WHEN k % 4 = 3 THEN 9 ELSE k % 4 END AS int)").where("k % 4 > 0")
    return contracts.best_response(rows.select("g", "o", "text"), "g", "text", "o", own).select("g", F.col("o").alias("best"))


# numbers and ranges

_ASKS = ("'Questions ' || (k % 40 + 1) || '-' || (k % 40 + 4)", "'Compare question ' || (k % 40 + 1) || ' and câu ' || (k % 40 + 2) || ' đến ' || (k % 40 + 9)", "'questions ' || (k % 40 + 9) || ' – ' || (k % 40 + 5)", "'no range here, ' || k", "'Câu hỏi từ ' || (k % 40 + 1) || ' to ' || (k % 40 + 3)")


@add(f"""SELECT k, k % 40 + 1 AS range_start, k % 40 + 4 AS range_end FROM {K} WHERE k % 5 = 0 UNION ALL SELECT k, k % 40 + 1, k % 40 + 1 FROM {K} WHERE k % 5 = 1 UNION ALL SELECT k, k % 40 + 2, k % 40 + 9 FROM {K} WHERE k % 5 = 1
    UNION ALL SELECT k, k % 40 + 5, k % 40 + 9 FROM {K} WHERE k % 5 = 2 UNION ALL SELECT k, k % 40 + 1, k % 40 + 3 FROM {K} WHERE k % 5 = 4""")
def question_ranges_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = made(spark, sf_dir, text=pick("k", *_ASKS))
    return asked.select("k", F.explode(R.query_ranges(F.col("text"))).alias("r")).select("k", F.col("r.start").cast("long").alias("range_start"), F.col("r.end").cast("long").alias("range_end"))


@add(f"SELECT k, {pick('k', 'k::DOUBLE', '-5.5::DOUBLE - k % 100', '(k % 1000)::DOUBLE', 'NULL', '3.25::DOUBLE + k % 50')} AS number, {pick('k', chr(39) + '+' + chr(39) + ' || k', chr(39) + '-' + chr(39) + ' || (5 + k % 100) || ' + chr(39) + '.5' + chr(39), chr(39) + '+' + chr(39) + ' || (k % 1000)', 'NULL', chr(39) + '+' + chr(39) + ' || (3 + k % 50) || ' + chr(39) + '.25' + chr(39))} AS signed FROM {K}")
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = pick("k", "'' || k", "'-' || (5 + k % 100) || '.5%'", "'about ' || (k % 1000) || ' apples, or 4'", "'none'", "(3 + k % 50) || ',25 to 4'")
    rows = made(spark, sf_dir, said=said).withColumn("number", tables.numeric_value(F.col("said")))
    return rows.select("k", "number", tables.format_signed(F.col("number")).alias("signed"))


@add(f"SELECT k, CAST(10 + k % 50 AS INTEGER) AS minutes, CASE WHEN k % 3 > 0 THEN CAST(100 + k % 200 AS INTEGER) END AS min_words FROM {K}")
def writing_prompt_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'You should spend about ' || (10 + k % 50) || ' minutes on this task. ' || CASE WHEN k % 3 > 0 THEN 'Write at  least ' || (100 + k % 200) || ' words.' ELSE 'Write 150 words.' END"
    return made(spark, sf_dir, text=said).select("k", spatial.prompt_figures(F.col("text")).alias("p")).select("k", "p.*")


@add("""WITH d AS (SELECT o_orderkey AS id, o_totalprice AS s, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30),
    w AS (SELECT o_orderkey AS id, o_totalprice % 97 + o_orderkey % 2 * 1000 + CASE WHEN o_totalprice > 300000 THEN 500 ELSE 0 END AS s FROM orders), x AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS r FROM w ORDER BY s DESC, id LIMIT 30),
    u AS (SELECT id, 0 AS n, r, s AS ds, 0.0::DOUBLE AS ks FROM d UNION ALL SELECT id, 1, r, 0.0, s FROM x)
    SELECT id AS chunk_id, round(sum(1 / (60.0::DOUBLE + r)), 9) AS rrf_score, CASE WHEN count(*) = 2 THEN 'dense,keyword' WHEN min(n) = 0 THEN 'dense' ELSE 'keyword' END AS methods FROM u GROUP BY id ORDER BY sum(1 / (60.0::DOUBLE + r)) DESC, max(ks) DESC, max(ds) DESC, min(n * 1000 + r) LIMIT 25""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("position"), F.col("o_totalprice").alias("price"))
    other = F.col("price") % 97 + F.col("chunk_id") % 2 * 1000 + F.when(F.col("price") > 300000, 500).otherwise(0)
    dense = rows.select("chunk_id", "position", F.col("price").alias("score")).orderBy(F.desc("score"), "position").limit(30)
    keyword = rows.select("chunk_id", "position", other.alias("keyword_score")).orderBy(F.desc("keyword_score"), "position").limit(30)
    return search.fuse(25, dense=dense, keyword=keyword).select("chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("methods", ",").alias("methods"))


# recognised pages


# the first and last names end in 0 now and then: nothing but white space is trimmed


@add(f"SELECT k, 'a' || k AS \"from\", 'b' AS \"to\" FROM {K} WHERE k % 3 > 0 UNION ALL SELECT k, 'b', 'c d' FROM {K} WHERE k % 3 = 2")
def text_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, text="CASE k % 3 WHEN 0 THEN 'alone ' || k WHEN 1 THEN 'a' || k || ' => b' ELSE 'a' || k || ' -> b → c d' END")
    return rows.select("k", F.explode(spatial.arrow_flow(F.col("text"))[1]).alias("e")).select("k", "e.from", "e.to")


@add(f"SELECT k, 'North' AS label, '12,' || k AS numbers FROM {K} UNION ALL SELECT k, 'South East', (k % 9) || ',6.5' FROM {K} WHERE k % 2 = 0")
def text_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, text=f"'Sales of ' || k || {NL} || 'North 12 ' || k || {NL} || CASE WHEN k % 2 = 0 THEN 'South East ' || (k % 9) || ' 6.5%' ELSE 'South East 5' END || {NL} || 'no numbers here'")
    return rows.select("k", F.explode(spatial.text_table_rows(F.col("text"))).alias("r")).select("k", "r.label", F.array_join("r.numbers", ",").alias("numbers"))


@add("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, CAST(l_quantity AS INTEGER) AS a, l_partkey AS b FROM lineitem)
    SELECT k, '|2019|2024' AS columns, array_to_string(list('L' || i || '|' || a || '|' || b ORDER BY i), ';') AS rows FROM l GROUP BY k""")
def ocr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as rows of a page: a label and two values, a pixel up or down from their row's height."""
    w = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)"
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", f"{w} as i", "cast(cast(l_quantity as int) as string) as a", "cast(l_partkey as string) as b")
    cell = lambda text, x, shift: f"named_struct('text', {text}, 'bbox', array(double({x}), double(20 * i + {shift}), double({x} + 10), double(20 * i + {shift} + 10)))"
    cells = lines.selectExpr("k", "i", f"explode(array({cell('b', 80, -1)}, {cell('a', 40, 1)}, {cell(quote('L') + ' || i', 0, 0)})) as line")
    heads = lines.select("k").distinct().withColumn("i", F.lit(0)).selectExpr("k", f"explode(array({cell(quote('2024'), 80, 0)}, {cell(quote('2019'), 40, 0)})) as line")
    pages = cells.select("k", "line").unionByName(heads.select("k", "line")).groupBy("k").agg(F.collect_list("line").alias("lines"))
    found = spatial.tables_of(pages, "k", "lines")
    return found.select("k", F.array_join("columns", "|").alias("columns"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


@add("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem), n AS (SELECT k, max(i) AS n FROM l GROUP BY k)
    SELECT l.k, l.i AS connector_id, CASE WHEN l.i % 2 = 0 THEN 'n' || (l.i + 1) ELSE 'n' || l.i END AS source, CASE WHEN l.i % 2 = 0 THEN 'n' || l.i ELSE 'n' || (l.i + 1) END AS target, l.i % 3 > 0 AS resolved FROM l JOIN n ON l.k = n.k WHERE l.i < n.n""")
def connector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a column of nodes; a connector joins each with the next, its head at one or the other."""
    w = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)"
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", f"{w} as i", "count(*) over (partition by l_orderkey) as n")
    nodes = lines.selectExpr("k", "'n' || i as node_id", "array(0.0D, double(40 * i), 10.0D, double(40 * i + 10)) as node_bbox")
    links = lines.where("i < n").selectExpr("k", "i as connector_id", "array(4.0D, double(40 * i + 11), 6.0D, double(40 * i + 39)) as connector_bbox", "5.0D as arrow_x", "double(40 * i + if(i % 2 = 0, 11, 39)) as arrow_y", "if(i % 3 > 0, 0.9D, 0.1D) as confidence")
    return spatial.edges(spatial.nearest_nodes(links, nodes, ["k"]), ["k"]).select("k", "connector_id", "source", "target", "resolved")


# papers

_RULES = (
    ("Do the statements agree? YES, NO or NOT GIVEN", "yes_no_not_given"), ("Write TRUE, FALSE or NOT GIVEN", "true_false_not_given"), ("Complete the table below", "table_completion"), ("Complete the flow-chart", "flowchart_completion"),
    ("Label the diagram", "diagram_labeling"), ("From the list of headings choose one for each paragraph", "matching_headings"), ("Match each name", "matching"), ("Choose the correct letter", "multiple_choice"), ("Give two examples", "short_answer_examples"),
    ("Choose no more than two words", "short_answer"), ("Choose one or 2 words", "short_answer"), ("Which two of the following are meant?", "multiple_choice"), ("From the list below choose", "multiple_choice"), ("A red B white C blue 7. which?", "matching"), ("Anything special", None),
)


@add(f"SELECT k, {pick_text('k', *(t for _, t in _RULES))} AS question_type FROM {K}")
def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, text=f"{pick_text('k', *(t for t, _ in _RULES))} || ' {{' || k || '}}'").select("k", structure.question_type(F.col("text")).alias("question_type"))


S = "(k % 20 + 1)"
_WINE = "'Wine has been made for thousands of years, ' || k || ' at least. It is old and people like it a lot in many countries.'"
_RIVERS = "'The water of ' || k || ' rivers flows down to the sea. It has done so for many thousands of years.'"
#: Pages of a paper: a passage with its questions, then another and a writing task.
_PAGES = (
    f"'READING PASSAGE ONE' || {NL} || {NL} || 'The Story of Wine' || {NL} || {NL} || {_WINE}",
    f"'Questions ' || {S} || '-' || ({S} + 2) || {NL} || 'Choose the correct letter A, B, C or D.' || {NL} || {S} || '. Vintage wines are A red B white C from one year D blended.' || {NL} || ({S} + 1) || '. Most wine is A sold young B kept C lost D given away.' || {NL} || ({S} + 2) || '. The author thinks A yes B no C both D neither.'",
    "'https://example.com/' || k",
    f"'READING PASSAGE TWO' || {NL} || {NL} || 'Rivers Run Deep' || {NL} || {NL} || {_RIVERS}",
    f"'Questions ' || ({S} + 3) || ' to ' || ({S} + 4) || {NL} || 'Write TRUE, FALSE or NOT GIVEN' || {NL} || ({S} + 3) || '. Rivers flow uphill.' || {NL} || ({S} + 4) || '. Water is wet.'",
    "'Writing Task 1: The bar chart below shows visitors of place ' || k || ' by age.'",
)
_PAPER = f" || {NL} || {NL} || ".join(_PAGES)
_FOUND = [(1, 0, 2, 0, "multiple_choice"), (1, 0, 2, 1, "multiple_choice"), (1, 0, 2, 2, "multiple_choice"), (2, 3, 4, 3, "true_false_not_given"), (2, 3, 4, 4, "true_false_not_given")]
_STEMS = ("Vintage wines are A red B white C from one year D blended.", "Most wine is A sold young B kept C lost D given away.", "The author thinks A yes B no C both D neither.", "Rivers flow uphill.", "Water is wet.")
_OPTIONS = ("A. red|B. white|C. from one year|D. blended.", "A. sold young|B. kept|C. lost|D. given away.", "A. yes|B. no|C. both|D. neither.", "", "")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_long(spark, sf_dir, text=_PAPER).withColumnRenamed("k", "document_id")


@add(" UNION ALL ".join(
    f"SELECT k, {p} AS passage_number, CAST({S} + {a} AS INTEGER) AS question_start, CAST({S} + {b} AS INTEGER) AS question_end, CAST({S} + {q} AS INTEGER) AS number, '{t}' AS question_type, {quote(_STEMS[q])} AS text, {quote(_OPTIONS[q])} AS options, '{'The Story of Wine' if p == 1 else 'Rivers Run Deep'}' AS title FROM {K}" for p, a, b, q, t in _FOUND))
def structure_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.parse_questions(_papers(spark, sf_dir))
    return found.select(F.col("document_id").cast("long").alias("k"), "passage_number", "question_start", "question_end", "number", "question_type", "text", F.array_join("options", "|").alias("options"), F.col("passage_title").alias("title"))


@add(f"SELECT k, 1 AS passage_number, 'The Story of Wine' AS title, {_WINE} AS text, {S} || '-' || ({S} + 2) AS groups FROM {K} UNION ALL SELECT k, 2, 'Rivers Run Deep', {_RIVERS}, ({S} + 3) || '-' || ({S} + 4) FROM {K}")
def passage_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.passages(_papers(spark, sf_dir))
    return found.select(F.col("document_id").cast("long").alias("k"), "passage_number", "title", "text", F.array_join("groups", ",").alias("groups"))


@add(f"SELECT k, 1 AS passages, {S} || '-' || ({S} + 2) AS ranges, 3::BIGINT AS questions FROM {K} UNION ALL SELECT k, 2, ({S} + 3) || '-' || ({S} + 4), 2 FROM {K}")
def paper_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.outline(structure.parse_questions(_papers(spark, sf_dir))).select("document_id", F.explode("passages").alias("p")).select("document_id", F.col("p.passage_number").alias("passages"), F.explode("p.groups").alias("g"))
    return rows.select(F.col("document_id").cast("long").alias("k"), "passages", F.concat_ws("-", "g.question_start", "g.question_end").alias("ranges"), F.col("g.questions").alias("questions"))


def _chunk(index: int, unit: str, chunk: str, text: str, parent: str, page: str, ids: str, low: str = "NULL", high: str = "NULL") -> str:
    return f"SELECT k, {index} AS chunk_index, '{unit}' AS unit_type, k || '-' || {chunk} AS chunk_id, {text} AS text, {parent} AS parent_id, '{page}' AS pages, '{ids}' AS element_ids, CAST({low} AS INTEGER) AS range_start, CAST({high} AS INTEGER) AS range_end FROM {K}"


def _question(index: int, q: int, low: int, high: int, page: str, ids: str) -> str:
    n = f"({S} + {q})"
    return _chunk(index, "question", f"'question-' || {n}", f"{n} || {quote('. ' + _STEMS[q])}", f"'questions-' || ({S} + {low}) || '-' || ({S} + {high})", page, ids, n, n)


def _shown(numbers: range, head: str) -> str:
    return head + "".join(f" || ' ' || ({S} + {q}) || {quote('. ' + _STEMS[q])}" for q in numbers)


@add(" UNION ALL ".join((
    _chunk(0, "document_outline", "'outline'", f"'Document: f.pdf' || {NL} || 'Exam Reading document outline.' || {NL} || 'Passage 1: The Story of Wine. Pages [1, 2]. Questions ' || {S} || '-' || ({S} + 2) || ' (multiple_choice).' || {NL} || 'Passage 2: Rivers Run Deep. Pages [3]. Questions ' || ({S} + 3) || '-' || ({S} + 4) || ' (true_false_not_given).'", "NULL", "1,2,3", ""),
    _chunk(1, "passage", "'passage-1-1'", f"'Passage 1: The Story of Wine' || {NL} || {NL} || {_WINE}", "'passage-1'", "1,2", "e0,e1"),
    _chunk(2, "question_group", f"'questions-' || {S} || '-' || ({S} + 2)", _shown(range(3), f"'Questions ' || {S} || '-' || ({S} + 2) || ' Choose the correct letter A, B, C or D.'"), "'passage-1'", "2", "e1", S, f"({S} + 2)"),
    *(_question(3 + q, q, 0, 2, "2", "e1") for q in range(3)),
    _chunk(6, "passage", "'passage-2-1'", f"'Passage 2: Rivers Run Deep' || {NL} || {NL} || {_RIVERS}", "'passage-2'", "3", "e3,e4"),
    _chunk(7, "question_group", f"'questions-' || ({S} + 3) || '-' || ({S} + 4)", _shown(range(3, 5), f"'Questions ' || ({S} + 3) || ' to ' || ({S} + 4) || ' Write TRUE, FALSE or NOT GIVEN'"), "'passage-2'", "3", "e4", f"({S} + 3)", f"({S} + 4)"),
    *(_question(5 + q, q, 3, 4, "3", "e4") for q in (3, 4)),
    _chunk(10, "writing_task", "'writing-1-writing_task-1'", f"'Task 1' || {NL} || 'The bar chart below shows visitors of place ' || k || ' by age.'", "'writing-task-1'", "3", "e5"),
)))
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = (1, 2, 2, 3, 3, 3)
    elements = ", ".join(f"named_struct('element_id', 'e{i}', 'page', {p}, 'text', {x}, 'confidence', 1.0D)" for i, (p, x) in enumerate(zip(pages, _PAGES, strict=True)))
    docs = made_long(spark, sf_dir, elements=f"array({elements})", source_file="'f.pdf'").withColumnRenamed("k", "document_id")
    found = structure.structured_chunks(docs, "Exam")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select(F.col("document_id").cast("long").alias("k"), "chunk_index", "unit_type", "chunk_id", "text", "parent_id", joined("pages"), joined("element_ids"), "range_start", "range_end")


# visuals of question groups


def _line(text: str, x: str, y: str, width: int = 30) -> str:
    return f"named_struct('text', {text}, 'bbox', array(double({x}), double({y}), double({x}) + {width}, double({y}) + 10), 'confidence', 0.8D)"


def _region(kind: str, lines: list[str], connectors: list[str]) -> str:
    none = "cast(array() as array<struct<id:string,bbox:array<double>,endpoints:array<array<double>>,head:array<double>,confidence:double>>)"
    own = f"array({', '.join(connectors)})" if connectors else none
    return f"named_struct('page', 2, 'kind', '{kind}', 'bbox', array(0.0D, 0.0D, 400.0D, 400.0D), 'confidence', 0.9D, 'lines', array({', '.join(lines)}), 'connectors', {own})"


def _connector(name: str, y: int, down: bool, sure: str) -> str:
    return f"named_struct('id', '{name}', 'bbox', array(104.0D, double({y}), 106.0D, double({y + 18})), 'endpoints', array(array(105.0D, double({y})), array(105.0D, double({y + 18}))), 'head', array(105.0D, double({y + 18 if down else y})), 'confidence', {sure})"


_TABLE_LINES = [_line("'Place'", "10", "60"), _line("'Sales ' || k", "110", "61"), _line("'Note'", "210", "59"), _line("'North'", "10", "90"), _line("'(' || (k % 9 + 1) || ')'", "112", "91"), _line("'x'", "208", "89"), _line("'South'", "9", "120"), _line("CASE WHEN k % 2 = 0 THEN 'gap ' || (k % 9 + 2) ELSE 'none' END", "111", "121"), _line("'y'", "211", "122")]
_FLOW_LINES = [_line("'The whole way'", "20", "10", 300), _line("'start ' || k", "80", "100", 50), _line("'then ' || (k % 9 + 1)", "80", "150", 50), _line("'of it'", "82", "161", 40), _line("'end ' || (k % 9 + 2)", "80", "211", 50)]
_FLOW_LINKS = [_connector("c1", 121, True, "0.9D"), _connector("c2", 182, False, "IF(k % 2 = 0, 0.9D, 0.2D)")]


@add(f"""SELECT k, 'table' AS kind, 'Place|Sales ' || k || '|Note' AS columns, 'North|(' || (k % 9 + 1) || ')|x;South|' || CASE WHEN k % 2 = 0 THEN 'gap ' || (k % 9 + 2) ELSE 'none' END || '|y' AS cells, '' AS nodes, '' AS edges,
    CASE WHEN k % 2 = 0 THEN '' ELSE 'missing_question_numbers' END AS issues, CASE WHEN k % 2 = 0 THEN 0.8::DOUBLE ELSE 0.7 END AS confidence FROM {K} WHERE k % 4 < 2
    UNION ALL SELECT k, 'flowchart', '', '', 'start ' || k || ';then ' || (k % 9 + 1) || ' of it;end ' || (k % 9 + 2), 'node-1>node-2' || CASE WHEN k % 2 = 0 THEN ',node-3>node-2' ELSE '' END, CASE WHEN k % 2 = 0 THEN '' ELSE 'unresolved_connectors' END, round(0.8::DOUBLE * (0.6 + 0.3 * CASE WHEN k % 2 = 0 THEN 1 ELSE 0.5 END), 4) FROM {K} WHERE k % 4 >= 2""")
def question_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two numbered rows, or a flow chart of three nodes of which the second connector points up."""
    from ..operators import visuals

    regions = f"array({_region('table', _TABLE_LINES, [])}, {_region('figure', _FLOW_LINES, _FLOW_LINKS)})"
    rows = made(spark, sf_dir, question_type="CASE WHEN k % 4 < 2 THEN 'table_completion' ELSE 'flowchart_completion' END", question_start="cast(k % 9 + 1 as int)", question_end="cast(k % 9 + 2 as int)", text="''", regions=regions)
    found = visuals.question_visuals(rows, ["k"])
    joined = lambda c: F.array_join(c, "|")
    return found.select(
        "k", "kind", joined("columns").alias("columns"), F.array_join(F.transform("rows", joined), ";").alias("cells"), F.array_join(F.transform("nodes", lambda n: n["text"]), ";").alias("nodes"),
        F.array_join(F.transform("edges", lambda e: F.concat(e["from"], F.lit(">"), e["to"])), ",").alias("edges"), F.array_join("issues", ",").alias("issues"), "confidence",
    )


@add(f"""SELECT k, {pick('k', "'| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' |  |'", "'- node-1: start ' || (k + 100) || chr(10) || '- node-2: [blanks: 7]' || chr(10) || '- edge: node-1 -> node-2'", "'- node-1: first ' || (k + 100) || chr(10) || '- node-2: then 7 [blanks: 7]'", "'- blank-7: [blanks: 7]' || chr(10) || '- blank-8: [blanks: 8]'")} AS text, {pick('k', '0.78', '0.7', '0.35', '0.35')}::DOUBLE AS confidence, {pick_text('k', '', '8', '8', '')} AS missing FROM {K}""")
def text_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visuals of groups without a region, from their texts."""
    from ..operators import visuals

    said = pick("k", f"'x' || {NL} || '| A | B |' || {NL} || '|---|---|' || {NL} || '| ' || k || ' |'", "'start ' || (k + 100) || ' → (7);'", f"'• first ' || (k + 100) || {NL} || '* then 7'", "'nothing here'")
    rows = made(spark, sf_dir, question_type="CASE WHEN k % 4 = 0 THEN 'table_completion' ELSE 'flowchart_completion' END", question_start="7", question_end="8", text=said, regions=f"cast(array() as array<{visuals.REGION}>)")
    found = visuals.shown(visuals.question_visuals(rows, ["k"]))
    return found.select("k", "text", "confidence", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


# packets of exact questions: orders as questions, by tens a passage, by fives a group

_MESSAGE = "Questions 1-99"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question k is told twice if k % 11 = 0; its parent is named (k % 3 = 1, with the document's id), lost (k % 7 = 0)
    or not given; groups of five share a passage, but each thirteenth question says another."""
    q = "cast(k as int)"
    questions = made(
        spark, sf_dir, chunk_id="'d-q' || k", unit_type="'question'", range_start=q, range_end=q, passage_number="cast((k - 1) div 10 + 1 + if(k % 13 = 0, 1, 0) as int)",
        parent_id="case when k % 7 = 0 then 'lost' when k % 3 = 1 then 'd-g' || ((k - 1) div 5) end", question_type=pick_text("k", "short_answer", "multiple_choice", None), instructions="cast(null as string)",
        text="k || '. Say it' || if(k % 3 = 1 and k % 2 = 0, ' A red B white C blue', '')", position="k * 10",
    )
    twins = questions.where("k % 11 = 0").withColumns({"chunk_id": F.concat("chunk_id", F.lit("b")), "position": F.col("position") + 1})
    groups = made(
        spark, sf_dir, chunk_id="'g' || ((k - 1) div 5)", unit_type="'question_group'", range_start="cast((k - 1) div 5 * 5 + 1 as int)", range_end="cast((k - 1) div 5 * 5 + 5 as int)", passage_number="cast((k - 1) div 10 + 1 as int)",
        parent_id="cast(null as string)", question_type="cast(null as string)", instructions="'Say no more than two words'", text="'Say it'", position="(k - 1) div 5 * 50",
    ).drop("k").distinct()
    passages = made(
        spark, sf_dir, chunk_id="'p' || ((k - 1) div 10 + 1)", unit_type="'passage'", range_start="cast(null as int)", range_end="cast(null as int)", passage_number="cast((k - 1) div 10 + 1 as int)",
        parent_id="cast(null as string)", question_type="cast(null as string)", instructions="cast(null as string)", text="'text'", position="(k - 1) div 10 * 100",
    ).drop("k").distinct()
    return questions.drop("k").unionByName(twins.drop("k")).unionByName(groups).unionByName(passages).withColumn("document_id", F.lit("d"))


_Q = """WITH q AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS lost, o_orderkey % 13 = 0 AS off, o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 AS options, CASE o_orderkey % 3 WHEN 0 THEN 'short_answer' WHEN 1 THEN 'multiple_choice' END AS stated FROM orders WHERE o_orderkey BETWEEN 1 AND 99 AND o_orderkey % 11 > 0)"""


@add(f"""{_Q} SELECT CAST(k AS INTEGER) AS number, CASE WHEN stated = 'multiple_choice' THEN 'multiple_choice' ELSE 'short_answer' END AS kind_or_none, CASE WHEN options THEN 'A,B,C' ELSE '' END AS labels, CASE WHEN lost OR off THEN '' ELSE 'p' || ((k - 1) // 10 + 1) END AS evidence,
    array_to_string(list_filter([CASE WHEN lost THEN 'missing_question_group' END, CASE WHEN off AND NOT lost THEN 'question_group_passage_mismatch' END, CASE WHEN stated = 'multiple_choice' AND NOT options THEN 'missing_answer_options' END], lambda x: x IS NOT NULL), ',') AS warnings,
    NOT (lost OR off OR coalesce(stated = 'multiple_choice' AND NOT options, false)) AS context_ready FROM q""")
def solve_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = dispatch.solve_packets(_sources(spark, sf_dir), _MESSAGE)
    kind = F.when(F.col("kind") == "unknown", "short_answer").otherwise(F.col("kind"))
    return packets.select("number", kind.alias("kind_or_none"), F.array_join("labels", ",").alias("labels"), F.array_join("evidence", ",").alias("evidence"), F.array_join("warnings", ",").alias("warnings"), "context_ready")


@add("""WITH a AS (SELECT unnest(generate_series(1, 99)) AS n), o AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey BETWEEN 1 AND 99)
    SELECT (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FROM a) AS requested, (SELECT coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') FROM o WHERE k % 11 > 0) AS found, (SELECT coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n), '') FROM a WHERE n NOT IN (SELECT k FROM o)) AS missing,
    (SELECT coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k), '') FROM o WHERE k % 11 = 0) AS ambiguous, CASE WHEN EXISTS (SELECT 1 FROM a WHERE n NOT IN (SELECT k FROM o)) THEN 'missing_exact_questions,' ELSE '' END || 'ambiguous_exact_questions,missing_question_groups,question_group_passage_mismatch,missing_passage_evidence,missing_answer_options' AS issues""")
def completeness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = dispatch.completeness(_sources(spark, sf_dir), _MESSAGE)
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return report.select(numbers("requested"), numbers("found"), numbers("missing"), numbers("ambiguous"), F.array_join("issues", ",").alias("issues"))
