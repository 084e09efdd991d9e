"""Plain loops stating the semantics that the distributed operators must reproduce."""
from __future__ import annotations

import math


def inter(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a, b):
    return inter(a, b) / (area(a) + area(b) - inter(a, b))


def nms(rows, threshold):
    """rows: (id, key, confidence, seq, box)."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[3])):
        if not any(k[1] == r[1] and inter(k[4], r[4]) and iou(k[4], r[4]) > threshold for k in kept):
            kept.append(r)
    return {k[0] for k in kept}


def fuse(rows, rules):
    """rows: dicts id, key, confidence, seq, box, window, cut, edges, look, parent. Returns entities and losers."""
    def same(a, b):
        common = inter(a["box"], b["box"])
        if a["key"] != b["key"] or not common:
            return False
        lo, hi = sorted((area(a["box"]), area(b["box"])))
        share, ratio = common / lo, lo / hi
        diag = lambda r: math.hypot(r["box"][2] - r["box"][0], r["box"][3] - r["box"][1])
        mid = lambda r: ((r["box"][0] + r["box"][2]) / 2, (r["box"][1] + r["box"][3]) / 2)
        away = math.dist(mid(a), mid(b)) / max(1, min(diag(a), diag(b)))
        linked = (a["parent"] is not None and a["parent"] in [b["id"], *b["merged"]]) or (b["parent"] is not None and b["parent"] in [a["id"], *a["merged"]])
        if linked and share >= rules.overlap and away <= 1.25 and ratio >= 0.1:
            return True
        if iou(a["box"], b["box"]) >= rules.iou and away <= rules.centre and ratio >= 0.35:
            return True
        if share >= rules.overlap and away <= rules.centre and ratio >= 0.5:
            return True
        if a["window"] == b["window"] or not (a["cut"] or b["cut"]) or share < rules.overlap or away > 1.25:
            return False
        lead = lambda r: bool(set(r["edges"]) & {"left", "top"})
        if not (lead(a) != lead(b) or not a["cut"] or not b["cut"]):
            return False
        if not a["look"] or not b["look"]:
            return False
        return sum(map(min, a["look"], b["look"])) / max(sum(a["look"]), sum(b["look"]), 1e-9) >= rules.appearance

    kept, lost, home = [], [], {}
    for row in sorted(rows, key=lambda r: (r["cut"], -r["confidence"], r["seq"])):
        row = {**row, "merged": [], "seen": [(row["window"], row["confidence"])]}
        spot = next((i for i, k in enumerate(kept) if same(k, row)), None)
        if spot is None:
            home[row["id"]] = len(kept)
            kept.append(row)
            continue
        old = kept[spot]
        home[row["id"]] = spot
        rank = lambda r: (not r["cut"], r["confidence"], area(r["box"]))
        win = row if rank(row) > rank(old) else old
        new = dict(win)
        if old["cut"] and row["cut"]:
            a, b = old["box"], row["box"]
            new["box"] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
            new["edges"] = sorted(set(old["edges"]) | set(row["edges"]))
        new["merged"] = [old["id"], *old["merged"], row["id"], *row["merged"]]
        new["seen"] = old["seen"] + row["seen"]
        best = {}
        for w, c in new["seen"]:
            best[w] = max(best.get(w, 0), c)
        scores = sorted(best.values(), reverse=True)
        new["confidence"] = min(0.99, scores[0] + 0.15 * sum(scores[1:]))
        new["parent"] = old["parent"] if old["parent"] is not None else row["parent"]
        lost.append(((old if win is row else row)["id"], win["id"], "cross_tile_duplicate" if old["window"] != row["window"] else "duplicate"))
        kept[spot] = new
    return kept, lost, home


def layer_order(items, edges):
    """items: (id, key); edges: (front, back)."""
    over = {}
    for f, b in edges:
        over.setdefault(f, set()).add(b)
    waiting, out = sorted(items, key=lambda i: (i[1], i[0])), []
    while waiting:
        ids = {i[0] for i in waiting}
        pick = next((i for i in waiting if not over.get(i[0], set()) & ids), None)
        if pick is None:
            return out + [i[0] for i in waiting]
        out.append(pick[0])
        waiting.remove(pick)
    return out


def match(preds, gts, threshold):
    """preds: (id, key, confidence, seq, box); gts: (id, key, box)."""
    used, out = set(), {}
    for p in sorted(preds, key=lambda p: (-p[2], p[3])):
        options = sorted(((-iou(p[4], g[2]), g[0]) for g in gts if g[1] == p[1] and inter(p[4], g[2]) and iou(p[4], g[2]) >= threshold))
        pick = next((g for _, g in options if g not in used), None)
        if pick is not None:
            used.add(pick)
            out[p[0]] = pick
        else:
            out[p[0]] = "duplicate" if options else "false_positive"
    return out


def budget(sources, total, retry):
    calls = retries = 0
    out = []
    for s in sources:
        ok = calls < total
        if ok and s in ("redetection", "gap_fill"):
            if retries >= retry:
                ok = False
            else:
                retries += 1
        calls += ok
        out.append(ok)
    return out
