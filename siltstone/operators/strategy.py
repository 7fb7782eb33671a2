"""How a request is answered from the store: arms tried in a fixed order, each a DataFrame of at most MOST rows.

An arm is a function that builds its DataFrame; it is run only if the ones before gave nothing, and what it gives is
taken by whether it has a row, so no arm's rows come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lookup
from .dispatch import filter_for_intent, requested_numbers, structured_lookup
from .search import MOST, probe

TOP_K, OVERVIEW_TOP_K, SPARE = 5, 12, 4


@dataclass(frozen=True)
class Request:
    message: str
    intent: str
    scope: list | None = None
    attached: tuple = ()
    explicit: bool = False
    vector: tuple | None = None


def structured_size(request: Request, top_k: int = TOP_K, overview_top_k: int = OVERVIEW_TOP_K) -> int:
    """How many rows a structured lookup may give."""
    numbers = requested_numbers(request.message) if request.intent == "solve_questions" else []
    if request.intent == "document_overview":
        return MOST
    if numbers:
        from ..functions.ranges import ranges_of

        return min(MOST, max(top_k, len(numbers) + len(ranges_of(request.message)) + SPARE))
    return max(top_k, overview_top_k)


def retrieve(chunks: DataFrame, request: Request, top_k: int = TOP_K, overview_top_k: int = OVERVIEW_TOP_K) -> tuple[DataFrame, str]:
    """Sources and the arm that gave them: structured, overview, explicit_scope, probe, or why there are none. Sources
    are then filtered for the intent."""
    size = structured_size(request, top_k, overview_top_k)
    solving = request.intent == "solve_questions" and bool(requested_numbers(request.message))
    shown = MOST if request.intent == "document_overview" else size if request.intent == "solve_questions" else top_k
    explicit = request.explicit and bool(request.scope) and set(request.scope) <= set(request.attached) and request.intent in ("translate_content", "semantic_qa")

    def probed() -> DataFrame:
        found = probe(chunks, request.message, list(request.vector) if request.vector else None, top_k, request.scope)
        strong = found.agg(F.coalesce(F.bool_or("strong"), F.lit(False)).alias("__strong"))
        scores = [c for c in found.columns if c not in chunks.columns]
        return chunks.join(F.broadcast(found.join(strong).where("__strong").select("chunk_id", *scores)), "chunk_id")

    arms: list[tuple[str, bool, Callable[[], DataFrame]]] = [
        ("structured", True, lambda: structured_lookup(chunks, request.message, request.intent, size, request.scope).limit(shown)),
        ("structured_question_no_match", solving, lambda: chunks.limit(0)),
        ("overview", request.intent == "document_overview", lambda: lookup.overview(chunks, overview_top_k, request.scope)),
        ("explicit_scope", explicit, lambda: lookup.document_chunks(chunks, top_k, request.scope)),
        ("probe", True, probed),
    ]
    ends = {"structured_question_no_match", "overview", "explicit_scope"}  # arms that are taken even if they give nothing
    for name, applies, build in arms:
        if not applies:
            continue
        rows = build()
        if name in ends or not rows.isEmpty():
            return filter_for_intent(rows, request.message, request.intent), name
    return chunks.limit(0), "no_strong_document_match"
