"""Every query of the library against its SQL on the smallest tables; the others for a stable schema."""

from difflib import SequenceMatcher

import pytest
from compare import duck_rows, spark_rows
from conftest import SF

from siltstone.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.schema == QUERIES[name](spark, SF).schema
    assert df.count() > 0


def test_ocr_similarity_of_all_pages(spark, tmp_path):
    """Against difflib, on pages of small and large numbers."""
    from siltstone.plans.analytics import ocr_similarity

    pages = {1: "Harbour lamps glow", 3: "Seven quiet rivers meet below", 120: "Copper kettles whistle at dawn", 121: "Letters arrive on Tuesday", 301: "Orchards bloom again", 5001: "Granite steps lead upward"}
    items = {1: "Seven  quiet rivers MEET below", 40: "Copper kettles whistle", 1667: "Something else entirely", 3000: "no page has this"}
    spark.createDataFrame(list(pages.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = set()
    seen = [(i * 3, "e2", t) for i, t in items.items()] + [(p, "e3", t + " zusatz eins zwei") for p, t in pages.items() if p % 4 == 1]
    for page, element, text in seen:
        native, own = " ".join(pages.get(page, "").lower().split()), " ".join(text.lower().split())
        like = SequenceMatcher(None, native, own).ratio()
        terms, there = set(own.split()), set(native.split())
        same = page in pages and (like >= 0.88 or len(terms & there) / len(terms) >= 0.92) and len(terms - there) / len(terms) < 0.08
        want.add((page, element, round(like, 4), same))
    got = [tuple(r) for r in ocr_similarity(spark, str(tmp_path)).select("page_id", "element_id", "similarity", "duplicate").collect()]
    assert len(got) == len(want) and set(got) == want


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
