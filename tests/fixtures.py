"""Hand-built CSV fixtures shaped like the two original sources.

The real files are not available; these follow the documented headers,
encodings (UTF-8 with BOM), row orders (live descending, frozen ascending)
and the thousands-separator rows (ROC 109/1 and 109/2 only). Values are a
deterministic rule, identical in both sources over the overlap.
"""

from __future__ import annotations

import csv
import io
import os

from panelforge import spec as S


def months(first, last):
    y, m = first
    while (y, m) <= last:
        yield y, m
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)


def value(y: int, m: int, code: str) -> int:
    i = (y - 2007) * 12 + (m - 1)
    base = {"ADSL": 4_000_000, "FTTX": 300_000, "CABLE_MODEM": 900_000, "LEASED_LINE": 1_500, "PWLAN": 20_000}[code]
    slope = {"ADSL": -14_000, "FTTX": 17_000, "CABLE_MODEM": 7_000, "LEASED_LINE": 3, "PWLAN": -60}[code]
    return max(0, base + slope * i + (i * 37 + len(code) * 11) % 997)


def fmt(n: int, commas: bool) -> str:
    return f"{n:,}" if commas else str(n)


def live_row(y, m):
    roc = y - S.ROC_OFFSET
    commas = (roc, m) in {(109, 1), (109, 2)}
    v = {c: value(y, m, c) for c in S.CAMP}
    sub_fixed = v["ADSL"] + v["FTTX"] + v["CABLE_MODEM"] + v["LEASED_LINE"]
    mobile = 25_000_000 + (y * 12 + m) % 1000
    sub_wireless = mobile + v["PWLAN"]
    dv, do = 20_000_000 + m, 5_000_000 + y
    cells = [sub_fixed, mobile, sub_wireless, sub_fixed + sub_wireless, dv, do, dv + do]
    row = [f"{roc}/{m}", fmt(v["ADSL"], commas), fmt(v["FTTX"], commas), fmt(v["CABLE_MODEM"], commas),
           fmt(v["LEASED_LINE"], commas), fmt(cells[0], commas), fmt(cells[1], commas), fmt(v["PWLAN"], commas),
           fmt(cells[2], commas), fmt(cells[3], commas), fmt(cells[4], commas), fmt(cells[5], commas),
           fmt(cells[6], commas)]
    return row


def frozen_row(y, m):
    v = {c: value(y, m, c) for c in S.CAMP}
    total = sum(v.values())
    return [str(y - S.ROC_OFFSET), str(m), str(v["ADSL"]), str(v["FTTX"]), str(v["CABLE_MODEM"]),
            str(v["LEASED_LINE"]), str(v["PWLAN"]), str(total)]


def live_rows(first=(2019, 1), last=(2026, 4)):
    return [live_row(y, m) for y, m in sorted(months(first, last), reverse=True)]


def frozen_rows(first=(2007, 1), last=(2020, 8)):
    return [frozen_row(y, m) for y, m in months(first, last)]


def write_csv(path: str, header, rows, bom: bool = True, raw_lines=None) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    buf = io.StringIO()
    w = csv.writer(buf, lineterminator="\n")
    w.writerow(header)
    for r in rows:
        w.writerow(r)
    text = buf.getvalue()
    if raw_lines:
        text += "".join(line + "\n" for line in raw_lines)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as fh:
        fh.write(text)
    return path


def write_live(path, rows=None, header=None, **kw):
    return write_csv(path, header or S.COLS_LIVE, live_rows() if rows is None else rows, **kw)


def write_frozen(path, rows=None, header=None, **kw):
    return write_csv(path, header or S.COLS_FROZEN, frozen_rows() if rows is None else rows, **kw)
