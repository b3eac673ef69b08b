"""The message run: enriched contacts in, one rendered message per recipient out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnout.functions.contact import Rules
from turnout.operators import messages as G, speakers as S

EV = "event_slug"


def plan_dispatch(enriched: DataFrame, registrants: DataFrame, events: DataFrame, matrix: DataFrame, angles: DataFrame,
                  variants: DataFrame, rules: Rules, paired: DataFrame | None = None) -> dict[str, DataFrame]:
    """Segment, resolve, split into arms, link and render; rows with leftover tokens are set apart."""
    rows = G.segments(enriched)
    suppressed = rows.filter("segment = 'suppressed'")
    mailable = rows.filter("segment <> 'suppressed'")
    if paired is not None:
        mailable = S.without_speakers(mailable, paired)
    contacts = G.contact_view(mailable.select(EV, "email", "segment"), enriched, registrants, rules)
    contacts = contacts.join(mailable.select(EV, "email", "segment"), [EV, "email"])
    rendered = G.recipients(G.links(G.arms(G.takeaways(contacts, matrix, angles)), events), variants)
    return {"recipients": rendered.filter("leftover = ''"), "unfilled": rendered.filter("leftover <> ''"),
            "suppressed": suppressed.select(EV, "email", "attendance_status", F.col("suppression_reason").alias("reason")),
            "redirect": G.demo_redirect(contacts), "snapshot": G.attendance_snapshot(enriched), "mix": G.audience_mix(contacts)}
