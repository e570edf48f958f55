"""Every operator as a query over the given tables, and the same in SQL."""

from emberlog.catalog import analysis, filters, scalars, sources

QUERIES = {**filters.QUERIES, **scalars.QUERIES, **analysis.QUERIES, **sources.QUERIES}
ORACLES = {**filters.ORACLES, **scalars.ORACLES, **analysis.ORACLES, **sources.ORACLES}
# Streams must give what the batch operators give.
ORACLES["stream_dedup"] = ORACLES["dedup_consecutive"].replace("message, repeat_count, text FROM", "message, repeat_count FROM")
ORACLES["stream_signposts"] = ORACLES["signpost_summary"]
ORACLES["stream_signpost_states"] = ORACLES["pairing_state"]
ORACLES["capture_signposts"] = analysis.captured_sql(
    sources.CAPTURED,
    """SELECT *, 'stream' AS mode, CASE WHEN count = 0 THEN 'nothing_paired' END AS hint_code,
        CASE WHEN (SELECT count(*) FROM first) >= {most} THEN 'count' ELSE 'exhausted' END AS stop_reason,
        (SELECT count(*) FROM first) AS events FROM totals""",
)
ORACLES["capture_signposts_intervals"] = analysis.captured_sql(sources.CAPTURED, analysis.RANKED_SUMMARIES)
