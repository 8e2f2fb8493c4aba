"""A static page from collected results: tables and two charts, rendered on the driver."""

from __future__ import annotations

import html

#: What the page calls the search variants: how, and over which text.
METHODS = {"bm25": "lexical", "dense": "vectors", "rrf": "lexical and vectors, fused"}
TEXTS = {"raw": "as the supplier wrote it", "norm": "with what was extracted", "oracle": "with the true attributes"}


def label(variant: str) -> tuple[str, str]:
    method, text, *more = [*variant.split("_"), "", ""][:3] if "_" in variant else (variant, "", "")
    return METHODS.get(method, method) + (", reranked" if "rerank" in more else ""), TEXTS.get(text, text)


KEYWORDS = ("select", "from", "join", "where", "group by", "order by", "limit", "with", "on", "as")


def percent(x: float | None, digits: int = 1) -> str:
    return "-" if x is None else f"{100 * x:.{digits}f}%"


def three(x: float | None) -> str:
    return "-" if x is None else f"{x:.3f}"


def milliseconds(x: float) -> str:
    """One decimal below ten, so that short times do not read as none."""
    return f"{x:.1f}" if x < 10 else f"{x:.0f}"


def cells(row, tag: str = "td") -> str:
    return "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in row)


def grid(head: list[str], rows: list[tuple[str, list]]) -> str:
    """A table; each row has a class and its cells."""
    body = "".join(f'<tr class="{kind}">{cells(row)}</tr>' for kind, row in rows)
    return f"<table><tr>{cells(head, 'th')}</tr>{body}</table>"


def ablation_table(variants: list[dict]) -> str:
    """Variants with the best nDCG marked; the variant with true attributes is a bound, not a rival."""
    variants = [{k.replace("@", "_"): x for k, x in v.items()} for v in variants]
    rivals = [v["ndcg_10"] or 0 for v in variants if "oracle" not in v["variant"]]
    best, rows = max(rivals, default=None), []
    for v in variants:
        kind = "oracle" if "oracle" in v["variant"] else "best" if (v["ndcg_10"] or 0) == best else ""
        measures = [three(v.get(m)) for m in ("recall_50", "p_1", "ndcg_10", "ndcg_10_en", "ndcg_10_zh", "mrr", "misorder")]
        rows.append((kind, [*label(v["variant"]), *measures, "-" if v.get("p50_ms") is None else milliseconds(v["p50_ms"])]))
    return grid(["method", "text", "recall@50", "P@1", "nDCG@10", "English", "Chinese", "MRR", "misorder", "ms a query"], rows)


def filter_table(filtered: dict, k: int = 10) -> str:
    """What each filtered mode returned of k rows."""
    rows = [("", [m["mode"], f"{three(m['avg_rows_returned'])} / {k}", three(m[f"recall@{k}"]), milliseconds(m["ms"])]) for m in filtered["modes"]]
    return f"<p>{percent(filtered['selectivity'], 2)} of rows pass; {filtered['nprobe']} lists are probed at a time.</p>" + grid(["mode", "rows", f"recall@{k}", "ms a query"], rows)


def build_table(builds: list[dict], k: int = 10) -> str:
    """Builds, with their recall at each number of probes."""
    probes = sorted({p["nprobe"] for b in builds for p in b["sweep"]})
    rows = []
    for b in builds:
        by = {p["nprobe"]: p[f"recall@{k}"] for p in b["sweep"]}
        rows.append(("", [b["lists"], f"{b['build_seconds']:.1f}", f"{b['index_mb']:.1f}", *(three(by.get(p)) for p in probes)]))
    return grid(["lists", "seconds", "MB", *(f"{p} probes" for p in probes)], rows)


def plot(points: list[tuple[float, float]], x: tuple[float, float], y: tuple[float, float], names: tuple[str, str], line: bool, size: list[float] | None = None) -> str:
    """Points in a frame of the given ranges, as SVG."""
    width, height, pad = 420, 300, 44

    def at(p):
        return tuple(round(a, 1) for a in (pad + (p[0] - x[0]) / ((x[1] - x[0]) or 1) * (width - 2 * pad), height - pad - (p[1] - y[0]) / ((y[1] - y[0]) or 1) * (height - 2 * pad)))

    places = [at(p) for p in points]
    marks = "".join(f'<circle cx="{a}" cy="{b}" r="{(size or [4] * len(places))[i]:.1f}"><title>{points[i][0]:.3f}, {points[i][1]:.3f}</title></circle>' for i, (a, b) in enumerate(places))
    joined = f'<polyline fill="none" stroke="black" points="{" ".join(f"{a},{b}" for a, b in places)}"/>' if line and places else ""
    frame = f'<rect x="{pad}" y="{pad}" width="{width - 2 * pad}" height="{height - 2 * pad}" fill="none" stroke="grey"/>'
    axes = f'<text x="{width / 2}" y="{height - 8}">{html.escape(names[0])}</text><text x="4" y="{pad - 8}">{html.escape(names[1])}</text>'
    return f'<svg viewBox="0 0 {width} {height}">{frame}{joined}{marks}{axes}</svg>'


def bar(share: float, width: int = 120) -> str:
    """A share as a filled part of a bar."""
    full = round(width * max(0.0, min(1.0, share)))
    return f'<svg viewBox="0 0 {width} 10"><rect width="{width}" height="10" fill="lightgrey"/><rect width="{full}" height="10"/></svg>'


def reliability(bins: list[dict]) -> str:
    """Accuracy against confidence; the area of a point is its rows."""
    total = sum(b["n"] for b in bins) or 1
    return plot([(b["mean_conf"], b["accuracy"]) for b in bins], (0.5, 1), (0.5, 1), ("confidence", "accuracy"), False, [4 + 10 * (b["n"] / total) ** 0.5 for b in bins])


def recall_curve(sweep: list[dict], k: int = 10) -> str:
    times = [s["seconds"] for s in sweep]
    return plot([(s["seconds"], s[f"recall@{k}"]) for s in sweep], (0, max(times, default=1)), (0, 1), ("seconds", f"recall@{k}"), True)


def verdict(bins: list[dict]) -> str:
    """What the bins say of the confidences."""
    if not bins:
        return "no answers"
    return "never overconfident" if all(b["accuracy"] >= b["mean_conf"] for b in bins) else "overconfident in some bins"


def pretty_sql(sql: str) -> str:
    """SQL with its keywords marked, escaped."""
    import re

    return re.sub(rf"\b({'|'.join(KEYWORDS)})\b", r"<b>\1</b>", html.escape(sql.strip(), quote=False), flags=re.IGNORECASE)


def example_rows(query: dict, titles: dict[str, str], variants: list[str]) -> str:
    """The first documents that each variant returned for a query; relevant before hard where both hold."""
    relevant, hard, rows = set(query["relevant"]), set(query["hard_negatives"]), []
    for v in variants:
        for d in query["top5"].get(v, []):
            rows.append(("relevant" if d in relevant else "hard" if d in hard else "", [" ".join(label(v)), d, titles.get(d, "")]))
    return f"<h3>{html.escape(query['text'])}</h3>" + grid(["method", "document", "title"], rows)


def page(report: dict) -> str:
    """The page of a report: extraction, retrieval, sweep, each where it is there."""
    parts = []
    if e := report.get("extraction"):
        facts = [("", [k, percent(e[k]) if isinstance(e[k], float) else e[k]]) for k in ("rows", "mapping_accuracy_clear_headers", "wrong_rate_clear_headers", "value_accuracy", "value_total", "normalization_errors")]
        parts += ["<h2>Extraction</h2>", grid(["measure", "value"], facts), reliability(e["calibration_bins"]), f"<p>{bar(e['value_accuracy'] or 0)} ECE {three(e['ece'])}: {verdict(e['calibration_bins'])}</p>"]
        parts.append(grid(["product", "header", "value", "truth", "said"], [("", [x["product"], x["header"], x["value"], x["truth"], x["pred"]]) for x in e["errors"][:10]]))
    if r := report.get("retrieval"):
        parts += ["<h2>Retrieval</h2>", ablation_table(r["variants"])]
        parts += [example_rows(q, r.get("titles", {}), [v["variant"] for v in r["variants"]]) for q in r.get("examples", [])]
    if s := report.get("sweep"):
        head = list(s[0])
        parts += ["<h2>Neighbours</h2>", recall_curve(s), grid(head, [("", [x[h] if not isinstance(x[h], float) else three(x[h]) for h in head]) for x in s])]
    if n := report.get("neighbours"):
        k = n.get("k", 10)
        parts += ["<h2>Neighbours</h2>", f"<p>{n['n']} rows; an exact scan takes {milliseconds(n['exact_ms'])} ms a query.</p>"]
        parts += [recall_curve([{"seconds": p["ms"] / 1000, f"recall@{k}": p[f"recall@{k}"]} for p in b["sweep"]], k) for b in n["builds"]]
        parts += [build_table(n["builds"], k), "<h2>Filtered neighbours</h2>", filter_table(n["filtered"], k)]
    if q := report.get("sql"):
        parts.append(f"<pre>{pretty_sql(q)}</pre>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body>{''.join(parts)}</body></html>"


def write_page(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(page(report))
