"""LOG-4: the outcome of a trace."""

from wayfare import contracts as C
from wayfare.operators.logs import read_logs, trace_outcome


def test_trace_outcomes(spark, tmp_path):
    import json
    t = "2026-06-20T09:00:0%d+00:00"
    analysis = lambda trace, agents, s=1: {"time": t % s, "event": "route_analysis_done", "trace_id": trace, "required_agents": agents}
    event = lambda trace, name, s=2, **k: {"time": t % s, "event": name, "trace_id": trace, **k}
    rows = [analysis("none", []), analysis("other", ["hotel_agent"]), analysis("null", [None]), analysis("called", ["hotel_agent", "ticket_agent"]),
            event("called", "a2a_call_start"), analysis("asked", []), event("asked", "route_need_clarification"),
            analysis("done", []), event("done", "route_query_done", status="success"), event("start", "route_query_start"),
            analysis("twice", []), analysis("twice", ["weather_agent"], 2), {"time": t % 1, "event": "route_analysis_done", "trace_id": "bare"}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, rows)))
    got = {r.trace_id: r.outcome for r in trace_outcome(read_logs(spark, str(tmp_path / "log.json"))).collect()}
    assert got == {"none": "no_supported_agent", "other": "no_supported_agent", "null": "no_supported_agent", "called": "open",
                   "asked": "need_clarification", "done": "success", "start": "open", "twice": "open", "bare": "open"}
    assert {"weather_agent", "ticket_agent"} == set(C.SUPPORTED_AGENTS)
