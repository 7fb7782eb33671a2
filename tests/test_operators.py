"""Operators on fixtures with known answers, and folds against plain loops."""

import re
from collections import deque

import pytest
from conftest import SF
from pyspark.sql import functions as F

from siltstone.operators import catalog, chunking, dispatch, lookup, quality, search, sessions, store, structure, tables, validate
from siltstone.sources import files
from siltstone.streaming import limits

COUNTRIES = [("A", [78, 96, 82, 99]), ("B", [61, 89, 67, 94]), ("C", [42, 75, 48, 83])]
COLUMNS = ["Internet Access 2019 (%)", "Internet Access 2024 (%)", "Smartphone Ownership 2019 (%)", "Smartphone Ownership 2024 (%)"]


@pytest.fixture(scope="module")
def countries(spark):
    rows = [("t", i, label, j + 1, COLUMNS[j], str(v)) for i, (label, values) in enumerate(COUNTRIES) for j, v in enumerate(values)]
    return spark.createDataFrame(rows, "table_id string, row_idx int, label string, col_idx int, column string, value string").cache()


def test_table_cell(countries):
    row = tables.cell_value(countries, "Smartphone Ownership of Country B in 2024").first()
    assert (row["value"], row["label"]) == ("94", "B")
    assert tables.cell_value(countries, "nothing known").count() == 0


def test_table_change(countries):
    rows = tables.changes(countries, "How did Internet Access change from 2019 to 2024?").orderBy("row_idx").collect()
    assert [r["change"] for r in rows] == [18.0, 28.0, 33.0]
    assert [r["label"] for r in rows if r["winner"]] == ["C"]
    with pytest.raises(ValueError):
        tables.changes(countries, "in 2019 only")


def test_table_summary(countries):
    first = tables.summary_facts(countries).orderBy("at").first()
    assert "A 78 -> 96 (+18); B 61 -> 89 (+28); C 42 -> 75 (+33). Largest increase: C (+33)." in first["changes"]
    assert "Ranking in 2024: A 96 > B 89 > C 75." in first["rankings"]
    assert tables.comparison_row(countries, "Country A").first()["cells"] == ["78", "96", "82", "99"]


def test_store_replaces_by_key(spark):
    schema = "chunk_id string, document_id string, source_file string, text string"
    old = spark.createDataFrame([("a-1", "doc-a", "r.pdf", "x"), ("b-1", "doc-b", "r.pdf", "y"), ("n", None, "n.pdf", "z")], schema)
    new = spark.createDataFrame([("a-2", "doc-a", "r.pdf", "w")], schema)
    assert store.has_document_ids(new)
    assert {r.chunk_id for r in store.upsert(old, new, "r.pdf", True).collect()} == {"a-2", "b-1", "n"}
    by_source = spark.createDataFrame([("c", None, "r.pdf", "w")], schema)
    assert {r.chunk_id for r in store.upsert(old, by_source, "r.pdf", False).collect()} == {"c", "n"}


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "chunk_id string, document_id string, source_file string"
    store.save(spark.createDataFrame([("a-1", "a", "f"), ("b-1", "b", "f")], schema), path)
    store.save(spark.createDataFrame([("a-2", "a", "f")], schema), path)
    assert {r.chunk_id for r in store.load(spark, path).collect()} == {"a-2", "b-1"}


def test_scopes(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 2)], "position long, document_id string, unit_type string, passage_number int")
    assert search.candidates(rows, document_ids=[]).count() == 0
    assert search.candidates(rows, unit_types=[], passage_numbers=[2]).first()["document_id"] == "b"


def test_question_lookup_prefers_group(spark):
    rows = spark.createDataFrame([(0, "question", 2, 2), (1, "question_group", 1, 4), (2, "question_group", 9, 9)], "position long, unit_type string, range_start int, range_end int").withColumn("document_id", F.lit("d"))
    found = lookup.question_lookup(rows, [(1, 4)], 5).collect()
    assert [r.position for r in found] == [1, 0]


def test_range_search_tiers(spark):
    rows = spark.createDataFrame([(0, None, None, "see 3. here"), (1, 1, 4, "x")], "position long, range_start int, range_end int, text string").withColumns({"unit_type": F.lit("question"), "document_id": F.lit("d")})
    assert [r.position for r in search.question_range_search(rows, "questions 3").collect()] == [1]
    assert [r.position for r in search.question_range_search(rows.where("position = 0"), "questions 3").collect()] == [0]


def test_canonical_ids(spark):
    row = spark.createDataFrame([("q-1", "d"), ("d-q-1", "d"), ("", "d"), ("x", "")], "c string, d string")
    assert [r[0] for r in row.select(lookup.canonical_chunk_id(F.col("c"), F.col("d"))).collect()] == ["d-q-1", "d-q-1", "", "x"]


def test_scope_resolution(spark):
    rows = spark.createDataFrame([("a", 240.0), ("b", 0.0)], "document_key string, score double")
    assert tuple(catalog.resolve_scope(rows).first()) == ("catalog_reference", ["a"])
    near = spark.createDataFrame([("a", 100.0), ("b", 95.0)], "document_key string, score double")
    assert catalog.resolve_scope(near).first()["method"] == "unresolved"
    assert catalog.resolve_scope(near.where("score = 95")).first()["method"] == "catalog_reference"
    assert catalog.resolve_scope(near, ["zzz"]).first()["method"] == "invalid_requested_scope"


def test_limiter_matches_loop():
    times = [0.0, 1.0, 2.0, 3.0, 60.0, 60.5, 61.0, 61.5, 200.0]
    accepted, held = [], []
    for t in times:
        held = [h for h in held if h > t - 60]
        accepted.append(len(held) < 3)
        held += [t] if accepted[-1] else []
    said = list(sessions.limiter(iter(times), 3, 60.0))
    assert [ok for ok, _ in said] == accepted
    assert all(wait >= 1 for ok, wait in said if not ok)
    kept = deque()
    list(sessions.limiter(iter(times[:4]), 3, 60.0, kept))
    assert list(kept) == [0.0, 1.0, 2.0]


def test_least_recent():
    assert sessions.least_recent(["a", "b", "c", "a", "d", "e"], 3) == (["a", "d", "e"], ["b", "c"])
    assert sessions.least_recent(["a", "b", "c"], 2, frozenset({"a"})) == (["a", "c"], ["b"])


def test_fold_keeps_every_element():
    own = [{"element_id": f"e{i}", "page": 1 + i // 5, "kind": "heading" if i % 17 == 0 else "paragraph", "text": "word " * (i % 90 + 1), "source": "s", "confidence": 1.0} for i in range(200)]
    seen = [e["element_id"] for group, _ in chunking.fold(own) for e in group]
    assert set(seen) == {e["element_id"] for e in own}
    assert sorted(set(seen), key=lambda x: int(x[1:])) == list(dict.fromkeys(seen))


def test_sentences_fit():
    text = "One two three. " * 900
    pieces = chunking.split_sentences(text, 100)
    assert " ".join(pieces).split() == text.split()
    assert all(chunking.tokens_in(p) <= 100 for p in pieces)
    assert all(chunking.tokens_in(p) <= 10 for p in chunking.split_words("word " * 100, 10))


def test_options():
    stem, options = structure.split_options("Wines are A red B white C old D new")
    assert stem == "Wines are" and [k for k, _ in options] == list("ABCD")
    assert structure.split_options("no options here") == ("no options here", [])


def test_outline(spark):
    text = "Questions 1-2\nMatch each\n1. a\n2. b\n\nQuestions 3\nChoose the correct letter\n3. x A p B q"
    found = structure.parse_questions(spark.createDataFrame([("d", text), ("e", None)], "document_id string, text string"))
    assert [(r.question_start, r.number, r.question_type) for r in found.orderBy("number").collect()] == [(1, 1, "matching"), (1, 2, "matching"), (3, 3, "multiple_choice")]
    assert len(structure.outline(found).first()["passages"][0]["groups"]) == 2


def test_contracts():
    assert validate.writing_contract("Write at least 250 words")["min_words"] == 250
    assert validate.writing_contract("write about 100 words")["target_words"] == (103, 109)
    assert validate.writing_contract("viết overview")["max_words"] == 80
    assert validate.plan_coverage("| Day | x |\n|---|---|\n| 1-3 | a |", "week")["day"] == {1, 2, 3}


def test_validators(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("x")).first()["x"]
    assert ask(validate.mismatch(F.lit("Đây là câu trả lời của bạn"), "Vietnamese")) == 0
    assert ask(validate.mismatch(F.lit("This is the answer to it"), "Vietnamese")) > 0
    assert ask(validate.mismatch(F.lit("Đây là câu trả lời của bạn"), "English")) > 0
    assert ask(validate.role_prefix(F.lit("**User:** hi"))) is None or ask(validate.role_prefix(F.lit("User: hi"))) == "user"
    assert ask(validate.looks_like_echo(F.lit("Do This now please"), F.lit("do this"))) is True
    facts = spark.createDataFrame([('{"facts":[{"key":"My Band","value":"6","evidence":"band 6"},{"key":"x","value":"y","evidence":"absent"}]}', "I am at band 6 now")], "r string, m string")
    assert [(r.key, r.value) for r in validate.stated_facts(facts, "r", "m").collect()] == [("my_band", "6")]


def test_dispatch():
    assert dispatch.passage_number("Reading Passage Two please") == 2
    assert "solve_questions" not in dispatch.allowed_intents("hello", {"table"})
    assert "table_cell" in dispatch.allowed_intents("hello", {"table"})
    assert dispatch.requested_numbers("questions 3-5 and question 4") == [3, 4, 5]
    assert dispatch.evidence_quota(12) == 1 and dispatch.evidence_quota(2) == 2


def test_quality_of_empty_page(spark):
    row = quality.page_quality(spark.createDataFrame([("", 0, 0.9)], "text string, text_block_count int, image_coverage double")).first()
    assert row["reasons"] == ["too_few_chars", "low_readable_ratio", "too_many_control_chars", "likely_scanned_page", "no_text_blocks"]
    assert not row["usable"] and row["score"] >= 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿First part.\r\n\r\nSecond-\nhand part.".encode())
    (tmp_path / "b.bin").write_bytes(b"\x00")
    found = files.read_files(spark, str(tmp_path))
    assert {r.source_file: r.route for r in found.collect()} == {"a.txt": "text", "b.bin": "unsupported"}
    assert [e["text"] for e in files.text_documents(found).first()["elements"]] == ["First part.", "Secondhand part."]
    assert files.ingest(spark, str(tmp_path), "Mock").first()["text"].startswith("[Page 1]\n\nFirst part.")


def test_token_stream():
    text = "A first sentence. Then a rather longer one follows here!\n\nEnd"
    assert "".join(limits.response_chunks(text)) == text
    assert limits.held_back("ends with no ma", ["no match"]) == 5
    assert "".join(limits.echo_guard(iter(["You must ", "answer"]), "You must answer now")) == ""
    assert "".join(limits.echo_guard(iter(["Hello ", "there"]), "You must")) == "Hello there"


def test_limit_stream(spark, tmp_path):
    rows = [("s", "chat", i, float(i)) for i in range(5)]
    schema = "session_id string, action string, event_id long, seconds double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = limits.limit_stream(stream, 3, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r.event_id: r.accepted for r in spark.table("limited").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}


# chunking against plain Python


def plain_sentences(text, most):
    """Greedy packing of sentences, restated: a piece is closed when the next sentence would make it too long."""
    size = lambda x: max(1, len(x) // 4)
    if size(text) <= most:
        return [text]
    pieces, held = [], []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        units = [sentence] if size(sentence) <= most else sentence.split()
        if len(units) > 1 or size(sentence) > most:
            pieces, held = pieces + [" ".join(held)], []
        for unit in units:
            if held and size(" ".join([*held, unit])) > most:
                pieces, held = pieces + [" ".join(held)], []
            held.append(unit)
        if size(sentence) > most:
            pieces, held = pieces + [" ".join(held)], []
    return [p.strip() for p in [*pieces, " ".join(held)] if p.strip()]


def test_sentence_split_of_all_documents(spark):
    from siltstone.operators.chunking import sentence_split

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for most in (20, 800):
        want = {(r["doc_id"], i, p, max(1, len(p) // 4)) for r in docs.collect() for i, p in enumerate(plain_sentences(r["text"] or "", most))}
        got = {(r["doc_id"], r["piece"], r["text"], r["token_count"]) for r in sentence_split(docs, "doc_id", most=most).collect()}
        assert got == want


def plain_chunks(elements, target=600, most=800, overlap=80):
    """The semantic fold, restated over indices: a chunk is a list of element numbers with its heading."""
    size = lambda x: max(1, len(x) // 4)

    def shown(numbers, heading):
        out, page = ([f"# {heading}"] if heading else []), None
        for i in numbers:
            e = elements[i]
            if e["page"] != page:
                page = e["page"]
                out.append(f"[Page {page}]")
            out.append(("## " if e["kind"] == "heading" else "") + e["text"].strip())
        return "\n\n".join(out)

    def kept(numbers):
        own, used = [], 0
        for i in reversed([i for i in numbers if elements[i]["kind"] != "heading"]):
            used += size(elements[i]["text"])
            if used > overlap:
                break
            own.insert(0, i)
        return own

    chunks, now, heading = [], [], None
    for i, e in enumerate(elements):
        if not e["text"].strip():
            continue
        full = now and (size(shown(now, heading)) >= target or size(shown([*now, i], heading)) > most)
        if now and (e["kind"] == "heading" or full):
            chunks.append((now, heading))
            now = kept(now)
        if e["kind"] == "heading":
            heading = e["text"]
        now = [*now, i]
    return [(shown(n, h), n) for n, h in [*chunks, *([(now, heading)] if now else [])]]


def test_semantic_chunks_of_all_documents(spark):
    from siltstone.operators.chunking import semantic_chunks
    from siltstone.plans.documents import _elements

    docs = _elements(spark, SF)
    want = {(str(r["document_id"]), i, text, tuple(f"e{n}" for n in numbers)) for r in docs.collect() for i, (text, numbers) in enumerate(plain_chunks([e.asDict() for e in r["elements"]]))}
    got = {(r["document_id"], r["chunk_index"], r["text"], tuple(r["element_ids"])) for r in semantic_chunks(docs).collect()}
    assert got == want and len(got) > 200


def test_response_chunks_of_all_turns(spark):
    from siltstone.plans.documents import response_chunks

    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = set()
    for r in rows:
        out, now = [], ""
        for part in re.findall(r"\S+\s*|\s+", r["text"]):
            now += part
            if len(now) >= 16 or "\n\n" in now or now.rstrip()[-1:] in tuple(".!?:;"):
                out, now = [*out, now], ""
        out += [now] if now or not out else []
        want |= {(r["conv_id"], r["turn"], i, p) for i, p in enumerate(out)}
    assert {(r["conv_id"], r["turn"], r["n"], r["chunk"]) for r in response_chunks(spark, SF).collect()} == want


# sources


def test_docx_and_pdf_files(spark, tmp_path):
    """Paragraphs, headings and ragged tables in order; a file that can't be read is a row with an error, not a failure."""
    import zipfile

    from siltstone.sources import files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    cell = lambda t: f"<w:tc><w:p>{run(t)}</w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{run("Title")}</w:p><w:p>{run("One  ")}{run("two")}</w:p><w:p/><w:tbl><w:tr>{cell("a|b")}{cell("c")}</w:tr><w:tr>{cell("d")}</w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "bad.pdf").write_bytes(b"not a pdf")
    (tmp_path / "a.png").write_bytes(b"picture")
    (tmp_path / "b.exe").write_bytes(b"no")
    found = files.read_files(spark, str(tmp_path))
    assert {r["source_file"]: r["route"] for r in found.collect()} == {"x.docx": "docx", "bad.pdf": "pdf", "a.png": "image", "b.exe": "unsupported"}
    elements = files.docx_documents(found).first()["elements"]
    assert [(e["kind"], e["text"]) for e in elements] == [("heading", "Title"), ("paragraph", "One two"), ("table", "| a\\|b | c |\n| --- | --- |\n| d |  |")]
    bad = files.pdf_documents(found).first()
    assert bad["elements"] == [] and bad["error"]
    seen = files.image_documents(found, lambda content: [(content.decode(), 0.5)]).first()["elements"]
    assert [(e["text"], e["source"], e["confidence"]) for e in seen] == [("picture", "ocr", 0.5)]
    assert files.needs_recognition("short", 0.0) and files.needs_recognition("long enough to stand alone as a page's text", 0.4)
    assert not files.needs_recognition("long enough to stand alone as a page's text", 0.1)


# streams


def test_upsert_stream_replaces_documents(spark, tmp_path):
    from siltstone.operators import store
    from siltstone.streaming.limits import upsert_stream

    schema = "document_id string, source_file string, text string"
    path, feed = f"{tmp_path}/store", f"{tmp_path}/feed"
    store.save(spark.createDataFrame([(f"d{i}", "f", f"old {i}") for i in range(40)] + [(None, "loose", "stays")], schema), path, 4)
    spark.createDataFrame([("d3", "f", "new a"), ("d3", "f", "new b"), ("d99", "g", "added")], schema).write.parquet(feed)
    for _ in range(2):  # a batch that comes again changes nothing
        query = upsert_stream(spark.readStream.schema(schema).parquet(feed), path, f"{tmp_path}/check{_}", 4)
        query.processAllAvailable()
        query.stop()
        got = sorted((r["document_id"] or "", r["text"]) for r in store.load(spark, path).collect())
        want = sorted([(f"d{i}", f"old {i}") for i in range(40) if i != 3] + [("", "stays"), ("d3", "new a"), ("d3", "new b"), ("d99", "added")])
        assert got == want


def test_echo_guard_and_held_back():
    from siltstone.streaming.limits import echo_guard, held_back

    assert held_back("so <thi", ["<think>", "</s>"]) == 4 and held_back("done", ["<think>"]) == 0
    assert "".join(echo_guard(iter(["Answer ", "only from", " this. ", "Yes"]), "answer only from this.")) == "Answer only from this. Yes"
    assert list(echo_guard(iter(["Answer ", "only"]), "answer only from this.")) == []
    assert list(echo_guard(iter(["No, ", "not so"]), "answer only from this.")) == ["No, ", "not so"]


def test_store_lies_in_buckets(spark, tmp_path):
    from siltstone.operators import store

    rows = spark.createDataFrame([(f"d{i}", "f", "x") for i in range(500)], "document_id string, source_file string, text string")
    store.save(rows, f"{tmp_path}/s", 8)
    assert len([p for p in (tmp_path / "s").iterdir() if p.name.startswith("bucket=")]) == 8 and store.load(spark, f"{tmp_path}/s").count() == 500


# contracts and titles


def test_response_contracts():
    from siltstone.operators.contracts import named_language, plan_issues, response_contract

    said = {
        "dịch sang tiếng Anh": "English", "trả lời giúp tôi bằng tiếng Anh": "English", "bằng tiếng anh": None, "viết một đoạn ngắn ra tiếng anh": "English", "translate it into English": "English", "tra loi bang tieng anh": "English",
        "dịch ra tiếng Việt": "Vietnamese", "in Vietnamese please": "Vietnamese", "hello": None,
    }
    assert {m: named_language(m) for m in said} == said
    own = response_contract("Lập kế hoạch 2 tháng, mỗi ngày 30 phút mỗi ngày", "direct", allow_solution=True)
    assert (own.plan_length, own.plan_unit, own.daily_minutes) == (2, "month", 30)
    weeks = "| Tuần | Việc |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(1, 9))
    assert plan_issues(weeks, own) == []
    assert plan_issues(weeks.replace("| 8 |", "| 9 |"), own) == ["The response exceeds the requested plan timeline.", "The response does not cover the full requested plan timeline."]
    assert plan_issues(weeks + "\n| 8 | again |\n45 phút/ngày", own) == ["The response contains duplicate plan periods.", "The response exceeds the requested daily time limit."]
    assert response_contract("translate questions 5 - 3", "translate_questions", True).required_numbers == ()


def test_titles_and_boundaries():
    from siltstone.operators.papers import Paper, TitleFinder, lines_of

    assert [(x.start, x.opens) for x in lines_of("a\n\n b\nc\n \nd")] == [(0, True), (4, True), (6, False), (10, True)]
    find = lambda t: (x := TitleFinder("Mock").best(t)) and x.text
    prose = "The river was long and it flowed through many lands for years."
    assert find(f"The Long River\n\n{prose}") == "The Long River" and find(f"Choose the correct letter\n\n{prose}") is None
    assert find(f"MOCK READING TEST 3\n\nThe Long River\n\n{prose}") == "The Long River"
    assert find(f"List of headings\n\n{prose}") is None
    text = f"Old Wine\n\n{prose}\n\nQuestions 1-2\nWrite TRUE, FALSE or NOT GIVEN\n1. A.\n2. B.\n\n[Page 2]\nNew Boats\n\n{prose} {prose}\n\nQuestion 3\nChoose no more than two words\n3. Say it. Task 1 write on"
    p = Paper(text)
    assert [(x.title, [(g.start, g.end, g.kind) for g in x.groups]) for x in p.passages] == [("Old Wine", [(1, 2, "true_false_not_given")]), ("New Boats", [(3, 3, "short_answer")])]
    assert p.passages[1].groups[0].questions[0].text == "Say it."
    both = Paper("Questions 1-2\n1. a\n\nQuestions 1 - 2\n1. a\n2. b")
    assert len(both.groups) == 1 and [q.number for q in both.groups[0].questions] == [1, 2]
    assert Paper("no numbered items").passages == [] and Paper("").groups == []


def test_visual_chunks_follow_their_group():
    from siltstone.operators.structure import chunks_of

    said = "Questions 7-8\nComplete the table below\n| A | B |\n|---|---|\n| 7 | x |\n\nQuestions 9-10\nComplete the flow-chart\nstart → (9) → ten 10\n\nQuestions 11-12\nComplete the table. 11. 12."
    own = chunks_of("d", "f.pdf", [{"element_id": "e1", "page": 1, "text": said, "confidence": 0.9}], "Mock")
    by = {c["chunk_id"]: c for c in own}
    assert by["d-table-7-8"]["text"] == "| A | B |\n| --- | --- |\n| 7 | x |" and by["d-table-7-8"]["min_confidence"] == 0.78
    assert "- edge: node-1 -> node-2" in by["d-flowchart-9-10"]["text"] and by["d-flowchart-9-10"]["parent_id"] == "questions-9-10"
    assert by["d-table-11-12"]["text"].startswith("Table Questions 11-12\nBlank question numbers: 11, 12\n")
    assert [c["chunk_index"] for c in own] == list(range(len(own)))
    region = {"page": 1, "kind": "table", "bbox": [0, 0, 100, 100], "confidence": 0.9, "connectors": [], "lines": [{"text": t, "bbox": [x, y, x + 8, y + 8], "confidence": 1.0} for t, x, y in [("H", 5, 5), ("I", 55, 5), ("7", 5, 30), ("u", 55, 30), ("v", 5, 60), ("8", 55, 60)]]}
    seen = {c["chunk_id"]: c for c in chunks_of("d", "f.pdf", [{"element_id": "e1", "page": 1, "text": said, "confidence": 0.9}], "Mock", regions=[region])}
    assert seen["d-table-7-8"]["text"] == "| H | I |\n| --- | --- |\n| 7 | u |\n| v | 8 |"


def test_ingest_of_a_folder(spark, tmp_path):
    """A paper gets its structure, another text the semantic fold, copies and unreadable files nothing of their own."""
    from siltstone.operators import store
    from siltstone.sources import files

    paper = "READING PASSAGE ONE\n\nThe Story of Wine\n\nWine has been made for years and people like it in many countries.\n\nQuestions 1-2\nWrite TRUE, FALSE or NOT GIVEN\n1. A.\n2. B."
    (tmp_path / "paper.txt").write_text(paper)
    (tmp_path / "copy.txt").write_text(paper)
    (tmp_path / "plain.md").write_text("Just a note.\n\nAnd another.")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF nothing")
    (tmp_path / "scan.png").write_bytes(b"Seen text")
    rows = files.ingest(spark, str(tmp_path), "Mock", recognise=lambda content: [(content.decode(), 0.5)])
    got = {(r["source_file"], r["unit_type"]): r["text"] for r in rows.collect()}
    assert set(got) == {("copy.txt", "document_outline"), ("copy.txt", "passage"), ("copy.txt", "question_group"), ("copy.txt", "question"), ("plain.md", None), ("scan.png", None)}
    assert got["plain.md", None] == "[Page 1]\n\nJust a note.\n\nAnd another." and "Seen text" in got["scan.png", None]
    old = spark.createDataFrame([(f"d{i}", "f") for i in range(28)], "document_id string, source_file string")
    r = files.accepted(old, rows).first()
    assert (r["documents"], r["accepted"]) == (31, False)
    assert store.quota_guard(store.stats(old)).first()["accepted"]


def test_embedded_tasks_of_a_paper():
    """A mark without a task is skipped; the next one keeps its number; a question's options stay with it."""
    from siltstone.operators.structure import chunks_of

    pages = lambda *texts: [{"element_id": f"e{i}", "page": i + 1, "text": t, "confidence": 1.0} for i, t in enumerate(texts)]
    paper = "Reading Passage 1\nTowns grow over time.\nQuestion 12\n12. From the list below choose the best name for Reading Passage 1.\nA Towns then\nB Growth for all\nC Change of minds\nD Homes within walls"
    own = chunks_of("d", "f", pages(paper, "Task 1", "TASK 2\nIn many towns, rents have been rising for years.\nSay why and what can be done."), "Mock")
    question = next(c for c in own if c["unit_type"] == "question")
    assert question["question_type"] == "multiple_choice" and "A Towns then" in question["text"] and "D Homes within walls" in question["text"]
    tasks = [c for c in own if c["unit_type"] == "writing_task"]
    assert [(c["task_index"], c["text"]) for c in tasks] == [(1, "Task 2\nIn many towns, rents have been rising for years. Say why and what can be done.")] and tasks[0]["pages"] == [3]


def test_composition_is_not_missed(spark):
    """Every character that composition changes is among those for which texts go through it, and marks are."""
    import unicodedata

    from siltstone.functions.text import COMPOSED_BLOCKS, nfc

    listed = lambda c: unicodedata.category(chr(c)).startswith("M") or any(a <= c <= b for a, b in COMPOSED_BLOCKS)
    assert [hex(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c) and not listed(c)] == []
    # what joins with a letter before it is a mark or a Hangul letter
    second = {ord(d[1]) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and len(d := unicodedata.normalize("NFD", chr(c))) == 2}
    assert all(listed(c) for c in second)
    texts = ["plain", "cafe\u0301", "caf\u00e9", "\u1112\u1161\u11ab", "\u212b", None, "", "\uf900 x", "o\u0302\u0301"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", nfc(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: t if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_evidence_in_any_rows(spark):
    """Several parts, repeated rows, nulls and short parts, against plain string search."""
    sources = [(1, "The old wine, it is said, was sold young in the north."), (1, "The old wine, it is said, was sold young in the north."), (2, "old wine it is"), (3, None), (4, "")]
    said = [("a", "old wine it is said"), ("a", "old wine it is said"), ("b", "The old wine ... sold YOUNG in the"), ("c", "old wine it … not there at all"), ("d", "wine is"), ("e", None), ("f", "ld wine, it i")]
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    want = set()
    for k, t in sources:
        for e, x in said:
            parts = [p for p in map(norm, re.split(r"\.{3,}|…", x or "")) if len(p.split()) >= 3]
            if parts and all(p in norm(t) for p in parts):
                want.add((k, e))
    got = validate.evidence_in(spark.createDataFrame(sources, "k int, t string"), "k", "t", spark.createDataFrame(said, "e string, x string"), "e", "x").collect()
    assert {(r["k"], r["e"]) for r in got} == want == {(1, "a"), (2, "f"), (1, "b"), (1, "f")} and len(got) == len(want)


def test_words_that_cancel_out_have_a_vector(spark):
    """Two words at one place with opposite signs, alone, twice and beside another; texts without words."""
    import xxhash

    from siltstone.operators import models

    at: dict[tuple[int, int], str] = {}
    for word in (f"w{i}" for i in range(1000)):
        h = xxhash.xxh64_intdigest(word.encode())
        at.setdefault((h % 64, h >> 63), word)
    place = next(p for p, s in at if s == 0 and (p, 1) in at)
    a, b = at[place, 0], at[place, 1]
    texts = [f"{a} {b}", f"{b} {a} {a} {b}", f"{a} {b} {at[next(k for k in at if k[0] != place)]}", " \n", None]
    rows = models.embed(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), models.HashingEmbedder(64)).orderBy("i").collect()
    assert [round(sum(x * x for x in r["embedding"]), 5) for r in rows] == [1, 1, 1, 0, 0]


LONG_WORK = ["structure_parse", "passage_titles", "structured_chunks", "answer_rewrite"]


@pytest.mark.parametrize("name", LONG_WORK)
def test_long_work_on_one_file_is_dealt_to_all_cores(spark, name):
    from siltstone.plans.catalogue import QUERIES

    assert QUERIES[name](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_paper_looks_once_for_a_title(monkeypatch):
    """A gap that begins a passage is looked at as a gap and as a passage, but only once searched and cleaned."""
    from siltstone.operators.papers import Paper, TitleFinder

    seen: list[tuple] = []
    find, clean = TitleFinder.found, Paper.cleaning
    monkeypatch.setattr(TitleFinder, "found", lambda self, *key: seen.append(key) or find(self, *key))
    monkeypatch.setattr(Paper, "cleaning", lambda self, body: seen.append((body,)) or clean(self, body))
    prose = "The river was long and it flowed through many lands for years."
    paper = Paper(f"Old Wine\n\n{prose}\n\nQuestions 1-2\nWrite TRUE, FALSE or NOT GIVEN\n1. A.\n2. B.\n\n[Page 2]\nNew Boats\n\n{prose} {prose}\n\nQuestion 3\n3. Say it.")
    assert [p.title for p in paper.passages] == ["Old Wine", "New Boats"] and len(seen) == len(set(seen)) > 4


def test_outline_shuffles_once(spark):
    rows = spark.createDataFrame([("d", 1, 1, 2, "matching", 1), ("d", 1, 1, 2, "matching", 2), ("d", 2, 3, 3, None, None), ("e", 1, 4, 4, None, 4)], "document_id string, passage_number int, question_start int, question_end int, question_type string, number int")
    found = structure.outline(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["document_id"]: [(p["passage_number"], [tuple(g) for g in p["groups"]]) for p in r["passages"]] for r in found.collect()}
    assert got == {"d": [(1, [(1, 2, "matching", 2)]), (2, [(3, 3, None, 0)])], "e": [(1, [(4, 4, None, 1)])]}


def test_review_asks_each_prompt_once_and_shuffles_nothing(spark, tmp_path):
    """Fine at once, better the second time, as bad the second time, worse the second time, null prompts; repeated keys."""
    from collections import Counter

    from siltstone.operators import contracts, models

    class Counting:
        """Answers as told; a prompt that is asked leaves a file behind."""

        def __init__(self, folder: str, said: dict[str, str]) -> None:
            self.folder, self.said = folder, said

        def answer(self, prompts: list[str]) -> list[str]:
            import uuid
            from pathlib import Path

            for p in prompts:
                Path(self.folder, f"{p}-{uuid.uuid4().hex}").touch()
            return [self.said.get(p, "") for p in prompts]

    contract = contracts.ResponseContract(language="Vietnamese", enforce_language=True, required_numbers=(1,))
    fine, none, wrong = "1. của tôi và bạn là gì", "của tôi và bạn là gì", "What is the answer to this and which words are they?"
    said = {"a": fine, "b": wrong, "b2": fine, "c": none, "c2": none, "d": none, "d2": wrong + "\n| a |"}
    keys = [(1, "a", "a2"), (2, "b", "b2"), (2, "c", "c2"), (4, "d", "d2"), (5, None, None)]
    made = models.reviewed(spark.createDataFrame(keys, "k int, prompt string, retry_prompt string"), Counting(str(tmp_path), said), contract)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.columns == ["k", "prompt", "retry_prompt", "text", "attempt", "issues"]
    got = {r["prompt"]: (r["text"], r["attempt"], len(r["issues"])) for r in made.collect()}
    assert got == {"a": (fine, 0, 0), "b": (fine, 1, 0), "c": (none, 0, 1), "d": (none, 0, 1), None: ("", 0, 2)}
    assert Counter(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == {"a": 1, "b": 1, "b2": 1, "c": 1, "c2": 1, "d": 1, "d2": 1, "": 2}


def test_answers_are_rewritten_without_repeated_expressions(spark):
    """Nested calls bind what they use more than once: a plan with hundreds of patterns was the cost. Unknown kinds, nulls and an unmarked single question."""
    from siltstone.operators import answers

    schema = "k int, text string, packets array<struct<number:int,kind:string,options:array<struct<label:string,text:string>>>>"
    wine = [("C", "Sold young"), ("D", "kept")]
    rows = [
        (1, "1. maybe\nRelationship: absent\n2. it is KEPT\n3. x", [(1, "true_false_not_given", None), (2, "matching", wine), (3, None, None)]),
        (2, "sold young", [(4, "multiple_choice", wine)]), (3, "5. sold young, kept", [(5, "multiple_choice", wine), (6, "matching", wine)]), (4, None, [(1, "matching", wine)]),
    ]
    out = answers.normalise_output(spark.createDataFrame(rows, schema))
    assert len(re.findall("regexp|rlike|split", out._jdf.queryExecution().optimizedPlan().toString().lower())) < 60
    got = {r["k"]: (r["text"], [tuple(a) for a in r["adjustments"]]) for r in out.collect()}
    assert got == {
        1: ("1. NOT GIVEN\nRelationship: absent\n2. D\n3. x", [(1, "NOT GIVEN", "relationship_mapping"), (2, "D", "option_text_mapping")]),
        2: ("Question 4: C\nsold young", [(4, "C", "option_text_mapping")]), 3: ("5. sold young, kept", []), 4: (None, []),
    }
