"""Results as JSON, as a table, and as a digest."""

from __future__ import annotations

import json
import resource
import struct
from dataclasses import asdict

from veltra.engine import Result
from veltra.plans.rewrite import Plan
from veltra.types import Type


def json_cell(value, kind: Type):
    """INT64 as a decimal string, so that no reader rounds it."""
    return str(value) if kind is Type.INT64 and value is not None else value


def result_dict(r: Result) -> dict:
    profile = r.plan.options.profile
    stats = {
        "peak_accounted_bytes": r.peak_bytes,
        "current_accounted_bytes": r.accounted_bytes,
        "scanned_rows": r.scanned_rows,
        "filtered_rows": r.filtered_rows,
        "operators": r.operators,
        "rule_applications": r.plan.applied,
        "join": {"build_side": r.plan.build_side, "reason": r.plan.reason},
        "engine": r.plan.options.engine,
        "batch_size": r.plan.options.batch_size,
        "accounting_scope": "bytes of loaded tables and of the collected result",
        "process_peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
        "rss_scope": "high-water mark of the driver's Python process",
    }
    if profile:
        stats["timings"] = {"planning_ns": r.planning_ns, "execution_ns": r.execution_ns, "scope": "wall time; execution includes the collected result"}
    kinds = [k for _, k in r.columns]
    return {
        "ok": True,
        "columns": [{"name": n, "type": k.value} for n, k in r.columns],
        "rows": [[json_cell(v, k) for v, k in zip(row, kinds, strict=True)] for row in r.rows],
        "stats": stats,
    }


def plan_dict(p: Plan) -> dict:
    stages = lambda found: [{**asdict(s), "engine": p.options.engine} for s in found]
    return {
        "ok": True,
        "optimizer": "on" if p.options.optimizer else "off",
        "unoptimized_logical": stages(p.logical),
        "optimized_logical": stages(p.optimized),
        "physical": stages(p.physical),
        "join": {"build_side": p.build_side, "reason": p.reason},
        "rule_applications": p.applied,
        "rules": {"prune": p.options.on("prune"), "pushdown": p.options.on("pushdown"), "fold": p.options.on("fold"), "build_side": p.options.on("join_reorder")},
    }


def table_text(r: Result) -> str:
    lines = ["\t".join(n for n, _ in r.columns)]
    for row in r.rows:
        lines.append("\t".join("NULL" if v is None else str(v) if k is Type.INT64 else json.dumps(v, ensure_ascii=False) for v, (_, k) in zip(row, r.columns, strict=True)))
    return "\n".join([*lines, f"({len(r.rows)} rows)"]) + "\n"


#: The 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def digest(r: Result) -> str:
    """FNV-1a over types and values in order: equal results in equal order have equal digests."""
    h = FNV_START

    def feed(raw: bytes) -> None:
        nonlocal h
        for b in raw:
            h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF

    for name, kind in r.columns:
        feed(name.encode() + b"\0" + kind.value.encode() + b"\0")
    for row in r.rows:
        for v, (_, kind) in zip(row, r.columns, strict=True):
            if v is None:
                feed(b"\0")
                continue
            feed(b"\1")
            if kind is Type.STRING:
                raw = v.encode()
                feed(struct.pack("<Q", len(raw)) + raw)
            else:
                feed(struct.pack({Type.INT64: "<q", Type.DOUBLE: "<d", Type.BOOL: "<?"}[kind], v))
    return f"{h:016x}"
