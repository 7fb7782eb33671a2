"""Fields of generated answers, by question: segments, heads, relationships, evidence, labels; and writing tasks in text.

Answers are long: one row for each question of a text. All are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions.text import collapse, let, strip

#: What a relationship answers, by kind of question, and what a task's text calls its figure.
RELATIONS = {"true_false_not_given": {"supports": "TRUE", "contradicts": "FALSE", "absent": "NOT GIVEN"}, "yes_no_not_given": {"supports": "YES", "contradicts": "NO", "absent": "NOT GIVEN"}}
TASKS = (1, 2)
PAGE_NOISE = (r"(?i)\n{1,3}\[Page\s+\d+\]", r"(?i)https?://\S+|Page\s+\d+")
FIGURES = [("pie chart", "pie_chart"), ("line chart", "line_chart"), ("bar chart", "bar_chart"), ("table", "table"), ("map", "map"), ("diagram", "diagram"), ("chart", "chart"), ("graph", "graph")]


def segments(texts: DataFrame, key: str, text: str, numbers: str) -> DataFrame:
    """texts: key, text, numbers (requested, an array). One row per number: the part of the text from its mark to the
    next requested one's; the whole text for a single number; empty without a mark."""
    rows = texts.select(key, text, numbers, F.explode(numbers).alias("number"))
    # the mark is found on the line itself, so that blank lines before it belong to the segment before
    mark = F.concat(F.lit(r"(?im)^\s*"), F.lit(G.one_of(*G.ITEM_WORDS) + r"?\s*"), F.col("number").cast("string"), F.lit(rf"\s*{G.any_char(G.NUMBER_ENDS)}"))
    rows = rows.withColumn("begin", F.regexp_instr(F.col(text), mark))
    alone = F.size(numbers) == 1
    later = F.lead("begin").over(Window.partitionBy(key).orderBy("begin"))
    stop = F.coalesce(F.col("stop"), F.length(text) + 1)
    marked = rows.where("begin > 0").withColumn("stop", later).select(key, "number", F.when(alone, F.col(text)).otherwise(F.substring(F.col(text), F.col("begin"), stop - F.col("begin"))).alias("segment"))
    return marked.unionByName(rows.where("begin = 0").select(key, "number", F.when(alone, F.col(text)).otherwise(F.lit("")).alias("segment")))


def _first_line(text: Column) -> Column:
    return F.element_at(F.split(strip(text), "\n", 2), 1)


def head(segment: Column, number: Column) -> Column:
    """The answer itself: the first line without its mark, its label, what follows on, and emphasis."""
    mark = F.concat(F.lit(rf"(?i)\A\s*{G.BULLET}{G.STARS}{G.one_of(*G.ITEM_WORDS)}?\s*"), number.cast("string"), F.lit(rf"\s*{G.any_char(G.NUMBER_ENDS)}\s*{G.STARS}"))
    line = _first_line(F.regexp_replace(segment, mark, F.lit("")))
    line = F.regexp_replace(line, rf"(?i)^\s*{G.one_of(*G.ANSWER_WORDS)}\s*[:\-–—]?\s*", "")
    follow = G.one_of(*G.EVIDENCE_WORDS, *G.RELATIONSHIP_WORDS, *G.EXPLANATION_WORDS)
    line = F.regexp_replace(line, rf"(?i)\s+(?:[-–—:]\s*)?{follow}\s*:.*$", "")
    return F.regexp_replace(strip(line), r"^[*_`]+|[*_`]+$", "")


def relationship(segment: Column) -> Column:
    """What the segment's relationship field says, if it is one of the three."""
    found = F.regexp_extract(segment, rf"(?im)^\s*{G.field(*G.RELATIONSHIP_WORDS)}({'|'.join(G.RELATIONSHIPS)})\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def evidence(segment: Column) -> Column:
    """From the evidence field to the relationship field or the end, without outer quotes."""
    after = F.regexp_extract(segment, rf"(?is)(?:^|\n)\s*{G.field(*G.EVIDENCE_WORDS)}(.*)\z", 1)
    own = F.element_at(F.split(after, rf"(?i)\n\s*{G.field(*G.RELATIONSHIP_WORDS)}", 2), 1)
    return F.regexp_replace(strip(own), "^[\"“”]+|[\"“”]+$", "")


def _plain(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_']+)"), 1), " ")


def option_label(answer: Column, options: Column) -> Column:
    """options: array of label and text. The one label whose text is in the answer; null for none or several."""
    named = F.transform(options, lambda o: F.struct(_plain(o["text"]).alias("text"), F.upper(o["label"]).alias("label")))
    hits = lambda said: F.array_distinct(F.transform(F.filter(named, lambda o: (o["text"] != "") & F.contains(said, o["text"])), lambda o: o["label"]))
    return let(_plain(answer), lambda said: F.when(said != "", let(hits(said), lambda h: F.when(F.size(h) == 1, F.get(h, F.lit(0))))))


def selected_labels(answer: Column, allowed: Column) -> Column:
    """Allowed labels that stand alone in the answer, longest first."""
    ordered = F.array_sort(F.transform(allowed, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("label"))))
    return F.transform(F.filter(ordered, lambda x: F.regexp_like(answer, F.concat(F.lit(r"(?i)(?<![A-Z])\Q"), x["label"], F.lit(r"\E(?![A-Z])")))), lambda x: x["label"])


def normalised_answer(kind: Column, segment: Column, number: Column, options: Column) -> Column:
    """What a relationship, or an option's text, stands for; null where the answer is to stay."""
    by_option = F.when(kind.isin("multiple_choice", "matching"), option_label(head(segment, number), options))
    return F.coalesce(relation_label(kind, relationship(segment)), by_option)


def relation_label(kind: Column, related: Column) -> Column:
    def of(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, known in RELATIONS.items():
            for said, label in known.items():
                out = F.when((kind == k) & (x == said), F.lit(label)).otherwise(out)
        return out

    return F.when(kind.isin(*RELATIONS), let(related, of))


def focused_source(blocks: DataFrame, key: str, block: str, position: str, required: list[int]) -> DataFrame:
    """Of each key's distinct blocks the one that names most required numbers, the shortest of equal ones; all of them,
    in order, if none names any."""
    first = blocks.groupBy(key, F.lower(collapse(F.col(block))).alias("__low")).agg(F.min_by(block, position).alias("b"), F.min(position).alias("p"))
    ints = lambda pattern, group: F.transform(F.regexp_extract_all("b", F.lit(pattern), group), lambda x: x.cast("int"))
    named = ints(rf"(?:^|\s)(\d{{1,3}})\s*{G.any_char(G.NUMBER_ENDS)}", 1)
    headers = rf"(?i){G.ITEM_WORDS[0]}s?\s*{G.span(r'(\d{1,2})', r'(\d{1,2})')}"
    covered = F.flatten(F.zip_with(ints(headers, 1), ints(headers, 2), lambda a, z: F.when(a <= z, F.sequence(a, z)).otherwise(F.array().cast("array<int>"))))
    wanted = F.array(*map(F.lit, required)).cast("array<int>")
    rows = first.withColumn("coverage", F.size(F.array_intersect(wanted, F.array_union(named, covered))))
    best = F.min_by(F.col("b"), F.struct(-F.col("coverage"), F.length("b"), F.col("p")))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "b"))), lambda x: x["b"]), "\n\n")
    return rows.groupBy(key).agg(F.when(F.max("coverage") > 0, best).otherwise(every).alias(block))


def paragraph_scope(text: Column, label: str) -> Column:
    """The part of a text between the paragraph of that label and the next label's: a label stands alone before a
    capitalised word."""
    opens = lambda x: rf"(?<![\p{{L}}\p{{N}}_]){x}\s+(?=[A-Z][a-z])"
    after = F.split(text, opens(label), 2)
    own = F.element_at(F.split(F.get(after, F.lit(1)), opens(chr(ord(label) + 1)), 2), 1)
    return F.when(F.size(after) == 2, F.nullif(own, F.lit("")))


def writing_tasks(texts: DataFrame, key: str, text: str, least: int = 6) -> DataFrame:
    """Tasks 1 and 2 that a text marks at the start of a line, each up to the next mark, if they have enough words:
    task_number, text, visual_type."""
    task = rf"(?im)^[ \t]*(?:writing\s+)?task\s*([{''.join(map(str, TASKS))}])\b\s*[-–:]?"
    parts = F.slice(F.split(F.regexp_replace(F.col(text), task, "\u0001$1\u0002"), "\u0001"), 2, 1 << 30)
    rows = texts.select(key, F.posexplode(parts).alias("task_index", "part"))
    body = F.substring_index("part", "\u0002", -1)
    for noise in PAGE_NOISE:
        body = F.regexp_replace(body, noise, " ")
    rows = rows.select(key, "task_index", F.substring("part", 1, 1).cast("int").alias("task_number"), collapse(body).alias("text"))
    kind = F.lit(None).cast("string")
    for words, name in reversed(FIGURES):
        kind = F.when(F.contains(F.lower("text"), F.lit(words)), name).otherwise(kind)
    return rows.where(F.regexp_count("text", F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*")) >= least).withColumn("visual_type", kind)


def question_stem(text: Column) -> Column:
    """A question without its number and, if two letters or more stand alone as option labels, without its options."""
    plain = strip(F.regexp_replace(strip(text), rf"^\s*\d{{1,2}}\s*{G.any_char('.)')}\s*", ""))
    label = r"(?<![A-Za-z0-9])[A-H](?=\s+\S)"
    return F.when(F.regexp_count(plain, F.lit(label)) >= 2, strip(F.element_at(F.split(plain, label, 2), 1))).otherwise(plain)


def evidence_query(questions: DataFrame, key: str, text: str, position: str) -> DataFrame:
    """The stems of a key's questions, each once, joined: what their evidence is searched by."""
    rows = questions.withColumn("__s", question_stem(F.col(text))).where("__s <> ''").groupBy(key, "__s").agg(F.min(position).alias("__p"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__s"))), lambda x: x["__s"]), " ").alias("query"))


def replace_answer(text: Column, number: Column, answer: Column, alone: Column) -> Column:
    """The text with what follows the number's mark on its line replaced by the answer; a single question without a
    mark gets a line of its own in front. Nothing else changes."""
    mark = F.concat(F.lit(rf"(?im)^\s*{G.BULLET}{G.STARS}{G.one_of(*G.ITEM_WORDS)}?\s*"), number.cast("string"), F.lit(rf"\s*{G.any_char(G.NUMBER_ENDS)}\s*{G.STARS}"))
    led = F.concat(F.lit("Question "), number.cast("string"), F.lit(": "), answer, F.lit("\n"), strip(text))

    def of(x: Column) -> Column:
        end = x["at"] + F.length(x["found"])
        rest = F.substring(text, end, F.length(text))
        return F.when(x["at"] > 0, F.concat(F.substring(text, F.lit(1), end - 1), answer, F.regexp_replace(rest, r"\A[^\n]*", ""))).when(alone, led).otherwise(text)

    return let(F.struct(F.regexp_instr(text, mark).alias("at"), F.regexp_substr(text, mark).alias("found")), of)


def normalise_output(rows: DataFrame, text: str = "text", packets: str = "packets") -> DataFrame:
    """rows: text, packets (array of number, kind, options) of the requested questions in order. Each question's answer
    is replaced by what its relationship or option text stands for, one question after the other; adjustments lists
    number, answer and reason of those that changed."""
    state = "struct<text:string,adjustments:array<struct<number:int,answer:string,reason:string>>>"

    def step(now: Column, packet: Column) -> Column:
        # each value that is used more than once is bound, or nested calls would work it out hundreds of times
        own = segment_of(now["text"], packet["number"], F.transform(F.col(packets), lambda p: p["number"]))
        mapped = lambda s: F.when(s != "", relation_label(packet["kind"], relationship(s)))
        by_option = lambda s: F.when((s != "") & packet["kind"].isin("multiple_choice", "matching"), option_label(head(s, packet["number"]), packet["options"]))
        chosen = lambda s: let(mapped(s), lambda m: F.struct(m.alias("mapped"), F.coalesce(m, by_option(s)).alias("answer")))

        def changed(c: Column) -> Column:
            new = F.when(c["answer"].isNull(), now["text"]).otherwise(replace_answer(now["text"], packet["number"], c["answer"], F.size(packets) == 1))
            change = F.struct(packet["number"].alias("number"), c["answer"].alias("answer"), F.when(c["mapped"].isNotNull(), F.lit("relationship_mapping")).otherwise(F.lit("option_text_mapping")).alias("reason"))
            return let(new, lambda n: F.struct(n.alias("text"), F.when(n != now["text"], F.array_append(now["adjustments"], change)).otherwise(now["adjustments"]).alias("adjustments")).cast(state))

        return let(let(own, chosen), changed)

    begin = F.struct(F.col(text).alias("text"), F.array().cast("array<struct<number:int,answer:string,reason:string>>").alias("adjustments")).cast(state)
    return rows.withColumn("__n", F.aggregate(packets, begin, step)).select(*[c for c in rows.columns if c != text], F.col("__n.text").alias(text), F.col("__n.adjustments").alias("adjustments"))


def segment_of(text: Column, number: Column, numbers: Column) -> Column:
    """segments() of one number as a column: from its mark to the nearest later mark of another requested number."""
    begin = lambda n: F.regexp_instr(text, F.concat(F.lit(r"(?im)^\s*" + G.one_of(*G.ITEM_WORDS) + r"?\s*"), n.cast("string"), F.lit(rf"\s*{G.any_char(G.NUMBER_ENDS)}")))
    later = lambda own: F.array_min(F.filter(F.transform(numbers, begin), lambda x: x > own))
    cut = let(begin(number), lambda own: F.when(own > 0, F.substring(text, own, F.coalesce(later(own), F.length(text) + 1) - own)).otherwise(F.lit("")))
    return F.when(F.size(numbers) == 1, text).otherwise(cut)


def answer_issues(kind: Column, segment: Column, number: Column, labels: Column, limit: Column, contract: Column, contained: Column) -> Column:
    """What is wrong with a question's answer: missing, no label or several, too many words, and, under a contract,
    evidence and relationship. labels: allowed labels (null: those of the kind). contained: whether the evidence was
    found in the question's sources, null where that is not asked."""
    says = lambda *parts: F.concat(F.lit("Question "), number.cast("string"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    own = strip(head(segment, number))
    known = F.lit(None).cast("array<string>")
    for k, answers in RELATIONS.items():
        known = F.when(kind == k, F.array(*map(F.lit, answers.values()))).otherwise(known)
    allowed = F.coalesce(F.when(F.size(labels) > 0, labels), known, F.array().cast("array<string>"))
    chosen, related, quoted = selected_labels(own, allowed), relationship(segment), evidence(segment)
    exact = F.exists(allowed, lambda x: F.lower(x) == F.lower(own))
    begins = F.exists(allowed, lambda x: F.regexp_like(own, F.concat(F.lit(r"(?i)\A\s*\Q"), x, F.lit(r"\E(?:\b|\s)"))))
    options, short = kind.isin("multiple_choice", "matching"), kind == "short_answer"
    words = F.regexp_count(own, F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'-]*"))
    bad_label = (F.size(chosen) != 1) | ~F.when(contract, exact).otherwise(begins)
    shape = (
        F.when(options & (F.size(allowed) < 2), says(" is missing its answer option contract."))
        .when((options | kind.isin(*RELATIONS)) & bad_label, says(" is missing a valid answer option label."))
        .when(short & limit.isNotNull() & (own == ""), says(" is missing a short answer."))
        .when(short & limit.isNotNull() & (words > limit), says(" exceeds its ", limit.cast("string"), "-word answer limit."))
    )
    under = F.array(
        F.when(quoted == "", says(" is missing an Evidence field.")),
        F.when(related.isNull(), says(" is missing a valid Relationship field.")).when((options | short) & (related != "supports"), says(" must use Relationship: supports for the selected answer.")),
        F.when((quoted != "") & (F.coalesce(related, F.lit("")) != "absent") & ~contained, says(" Evidence is not quoted from its selected passage evidence.")),
    )
    found = F.concat(F.array(shape), F.when(contract, under).otherwise(F.array().cast("array<string>")))
    return F.when(segment == "", F.array(says(" is missing from the response."))).otherwise(F.array_compact(found))


def expand_query(turns: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """A follow-up's query: the last user message before it, then its own words."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("role") == "user", F.col(text)), ignorenulls=True).over(w)
    return turns.withColumn("query", F.concat_ws("\n", before, text)).where("role = 'user'")
