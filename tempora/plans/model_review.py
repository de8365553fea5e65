"""Model review of annotation packets, resumable."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora import ontology, schemas
from tempora.plans.extract import _EVENT_FIELDS, _PERSON, _RELATION, _TEXT, _list, _object

GOLD_SCHEMA = _object(
    article_id=_TEXT, annotation_notes=_list(_TEXT), entities=_list(_object(name=_TEXT, type={"enum": list(ontology.ENTITY_TYPES)}, aliases=_list(_TEXT))), relations=_list(_RELATION),
    events=_list(_object(**_EVENT_FIELDS, participants=_list(_PERSON), relations=_list(_RELATION), evidence=_TEXT)),
)
#: What a review reads of a packet.
PACKET = f"article_id string, text string, draft struct<{schemas.GOLD.replace(' ', ':').replace(',:', ',')}>"
INSTRUCTIONS = "Correct the draft so that it holds exactly the geopolitical events that the article reports, with exact quotes as evidence."


def review(packets: DataFrame, make_annotator: Callable[[], Callable[[str], dict]], done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """article_id, status (ok or failed), record (JSON with annotation_status model_reviewed), error of packets that aren't in `done`."""
    rows = packets.select("rec_ord", "article_id", "text", F.to_json("draft").alias("draft"))
    if limit:
        rows = rows.orderBy("rec_ord").limit(limit)
    if done is not None:
        rows = rows.join(done.select("article_id").distinct(), "article_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotate = make_annotator()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    found = annotate(f"Article:\n{row['text'] or ''}\n\nDraft:\n{row['draft']}")
                    out.append((row["article_id"], "ok", json.dumps(found | {"article_id": row["article_id"], "annotation_status": "model_reviewed"}, ensure_ascii=False), None))
                except Exception as problem:  # one packet's failure is a row
                    out.append((row["article_id"], "failed", None, f"{problem}"))
            yield pd.DataFrame(out, columns=["article_id", "status", "record", "error"])

    return rows.mapInPandas(run, "article_id string, status string, record string, error string")
