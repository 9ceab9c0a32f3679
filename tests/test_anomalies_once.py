"""The detectors of the batch analysis read the events from a table."""

from logsight.plans import batch
from logsight.plans.base import HOUR
from logsight.plans.catalogue import QUERIES


def test_lines_are_parsed_once(spark, sf_dir, monkeypatch):
    """What the detectors get has no parsing left in its plan, and every event has all scores."""
    seen = []

    def watched(events, *more):
        seen.append(events._jdf.queryExecution().optimizedPlan().toString())
        return anomalies(events, *more)

    anomalies = batch.anomalies
    monkeypatch.setattr(batch, "anomalies", watched)
    rows = QUERIES["a19_detectors_only"](spark, sf_dir).collect()
    assert "regexp" not in seen[0] and "Relation" in seen[0]
    assert len(rows) == len({r.event_id for r in rows}) == 1000
    assert any(r.sequence for r in rows) and any(r.volume for r in rows)
