"""Workflows as JSON: nodes with a type and parameters, edges from port to port, one lazy DataFrame a node."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.operators import dedup, measures, relate, rules, series, tables
from tallygrove.report import OpResult, Refusal

Operator = Callable[[Mapping[str, DataFrame], Mapping], DataFrame | OpResult]


def _rules(params: Mapping) -> list[rules.Rule]:
    def value(v):
        return rules.Compute(**v) if isinstance(v, Mapping) else v

    return [rules.Rule(r["column"], value(r["value"]), [[rules.Condition(**c) for c in some] for some in r.get("when", [[]])]) for r in params["rules"]]


#: Node type: its required ports and what it does.
OPERATORS: dict[str, tuple[tuple[str, ...], Operator]] = {
    "select_rows": (("table",), lambda i, p: tables.leave_out(i["table"], p["column"], p["values"]) if p.get("leave_out") else tables.select_values(i["table"], p["column"], p["values"]) if "values" in p else tables.select_range(i["table"], p["column"], p.get("low"), p.get("high"), p.get("kind", "number"))),
    "group_table": (("table",), lambda i, p: tables.group(i["table"], p["by"], p["value"], p.get("how", "sum"), p.get("name", "value"), p.get("exclude_missing", False))),
    "relate_table": (("records", "related"), lambda i, p: relate.relate(i["records"], i["related"], [tuple(k) for k in p["on"]], p["bring"], p.get("gaps", "drop"), p.get("label"), p.get("several", "refuse"), p.get("compare", "exact"))),
    "append_rows": (("first", "second"), lambda i, p: tables.append(i, p.get("source"), p.get("line_up"))),
    "case_series": (("records",), lambda i, p: series.case_series(i["records"], F.col(p["date"]), p["unit"], F.col(p["weight"]) if p.get("weight") else None, p.get("split", ()))),
    "rate": (("records",), lambda i, p: measures.rate(i["records"], F.col(p["numerator"]), F.col(p["denominator"]), p.get("by", ()), p.get("multiplier", 1.0), tuple(p["band"]) if p.get("band") else None, p.get("least", 0.0))),
    "two_by_two": (("records",), lambda i, p: measures.two_by_two(i["records"], F.col(p["exposed"]) == F.lit(p["exposed_is"]), F.col(p["case"]) == F.lit(p["case_is"]), p.get("by", ()), p.get("level", 95))),
    "apply_ruleset": (("records",), lambda i, p: rules.apply_rules(i["records"], _rules(p), p.get("otherwise"))),
    "sort": (("table",), lambda i, p: tables.sort_blanks_last(i["table"], p["column"], p.get("descending", False), p.get("numeric", False))),
    "crosstab": (("table",), lambda i, p: tables.crosstab(i["table"], p["row"], p["column"], F.col(p["value"]))),
    "deduplicate": (("table",), lambda i, p: dedup.dedup_table(i["table"], p["key"], p["order"])),
}


@dataclass
class Workflow:
    nodes: dict[str, tuple[str, dict]]
    inputs: dict[str, dict[str, str]] = field(default_factory=dict)  # node: {port: source node}

    @classmethod
    def from_json(cls, text: str) -> Workflow:
        raw = json.loads(text)
        flow = cls({n["id"]: (n["type"], n.get("params", {})) for n in raw["nodes"]})
        if len(flow.nodes) < len(raw["nodes"]):
            raise Refusal("two nodes have one id")
        for e in raw.get("edges", []):
            ports = flow.inputs.setdefault(e["to"], {})
            if e["from"] not in flow.nodes or e["to"] not in flow.nodes or e["port"] in ports:
                raise Refusal(f"the edge {e['from']} to {e['to']} has no end, or its port is taken")
            ports[e["port"]] = e["from"]
        return flow

    def order(self, wanted: list[str]) -> list[str]:
        """The wanted nodes and what they need, inputs first; nodes that nothing wanted needs are left out."""
        out: list[str] = []
        path: list[str] = []

        def visit(n: str) -> None:
            if n in out:
                return
            if n in path:
                raise Refusal(f"the workflow runs in a circle at {n}")
            kind = self.nodes[n][0]
            if kind != "table_input":
                if kind not in OPERATORS:
                    raise Refusal(f"no such operator: {kind}")
                lacking = [p for p in OPERATORS[kind][0] if p not in self.inputs.get(n, {})]
                if lacking:
                    raise Refusal(f"{n} has nothing at {', '.join(lacking)}")
            path.append(n)
            for source in self.inputs.get(n, {}).values():
                visit(source)
            path.pop()
            out.append(n)

        for n in wanted:
            visit(n)
        return out

    def run(self, tables_: Mapping[str, DataFrame], wanted: list[str]) -> dict[str, DataFrame]:
        """Lazy results of the wanted nodes; ``tables_`` holds the input tables by the name in their ``table`` parameter."""
        done: dict[str, DataFrame] = {}
        for n in self.order(wanted):
            kind, params = self.nodes[n]
            if kind == "table_input":
                done[n] = tables_[params["table"]]
                continue
            got = OPERATORS[kind][1]({p: done[s] for p, s in self.inputs.get(n, {}).items()}, params)
            done[n] = got.df if isinstance(got, OpResult) else got
        return {n: done[n] for n in wanted}
