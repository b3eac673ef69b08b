"""The content run: transcript lines and generated assets in, verdicts and clips out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnout.operators import grounding as G, transcript as X
from turnout.session import settled

EV = "event_slug"


def check_assets(lines: DataFrame, files: DataFrame, assets: DataFrame, roster: DataFrame) -> dict[str, DataFrame]:
    """Verify every claim of every asset against its event's transcript.

    ``lines``: event_slug, line_no, line; ``files``: event_slug, chapter,
    duration_sec; ``assets``: event_slug, asset_id, kind, text; ``roster``:
    event_slug, name.
    """
    keyed = lines.withColumnRenamed(EV, "recording_id")
    turns = settled(X.turns_of(keyed))
    stamps = settled(X.valid_stamps(turns.select("recording_id", "sec"), X.segment_seconds(keyed),
                                    X.boundary_seconds(X.chapters(files))).toDF(EV, "sec"))
    windows = X.windows(turns).withColumnRenamed("recording_id", EV)
    verdicts = settled(G.verified_claims(G.claims(assets), turns.withColumnRenamed("recording_id", EV), windows, stamps, roster))
    digest = G.failure_digest(verdicts)
    return {"verdicts": verdicts, "totals": G.grounding_totals(verdicts), "digest": digest, "flagged": G.flagged_text(assets, digest),
            "spec": G.spec_problems(assets, stamps), "stats": G.undefined_stats(assets.filter("kind = 'infographic.md'")), "stamps": stamps}
