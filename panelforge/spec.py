"""Declared specs: what a source must look like and how the panel is grouped.

A spec is plain data, fixed before anyone looks at the numbers. Operators read
it; nothing in the package edits it at run time.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original pipeline's for right results
# (headers, codes, groups, tolerances, thresholds, anchors, source tags).
# ---------------------------------------------------------------------------

SRC_LIVE = "ncc_7164"      # live source A tag
SRC_FROZEN = "ncc_27953"   # frozen source B tag

COLS_LIVE = [
    "年月",
    "ADSL_固網（有線）寬頻帳號數",
    "FTTX_固網（有線）寬頻帳號數",
    "Cable_Modem固網（有線）寬頻帳號數",
    "Leased_Line_固網（有線）寬頻帳號數",
    "小計_固網（有線）寬頻帳號數",
    "行動寬頻_無線寬頻帳號數",
    "PWLAN_無線寬頻帳號數",
    "小計_無線寬頻帳號數",
    "合計_寬頻帳號數",
    "Data+Voice_實際行動寬頻上網帳號數",
    "Data only_實際行動寬頻上網帳號數",
    "合計_實際行動寬頻上網帳號數",
]

COLS_FROZEN = [
    "年度",
    "月份",
    "有線寬頻帳號-ADSL",
    "有線寬頻帳號-FTTX",
    "有線寬頻帳號-Cable Modem",
    "有線寬頻帳號-固接專線",
    "無線寬頻帳號-PWLAN",
    "總計",
]

MAP_LIVE = {
    "ADSL_固網（有線）寬頻帳號數": "ADSL",
    "FTTX_固網（有線）寬頻帳號數": "FTTX",
    "Cable_Modem固網（有線）寬頻帳號數": "CABLE_MODEM",
    "Leased_Line_固網（有線）寬頻帳號數": "LEASED_LINE",
    "PWLAN_無線寬頻帳號數": "PWLAN",
}

MAP_FROZEN = {
    "有線寬頻帳號-ADSL": "ADSL",
    "有線寬頻帳號-FTTX": "FTTX",
    "有線寬頻帳號-Cable Modem": "CABLE_MODEM",
    "有線寬頻帳號-固接專線": "LEASED_LINE",
    "無線寬頻帳號-PWLAN": "PWLAN",
}

# live subtotal excludes PWLAN; frozen total includes it
SUM_LIVE_TOTAL = "小計_固網（有線）寬頻帳號數"
SUM_LIVE_PARTS = [
    "ADSL_固網（有線）寬頻帳號數",
    "FTTX_固網（有線）寬頻帳號數",
    "Cable_Modem固網（有線）寬頻帳號數",
    "Leased_Line_固網（有線）寬頻帳號數",
]
SUM_FROZEN_TOTAL = "總計"
SUM_FROZEN_PARTS = [
    "有線寬頻帳號-ADSL",
    "有線寬頻帳號-FTTX",
    "有線寬頻帳號-Cable Modem",
    "有線寬頻帳號-固接專線",
    "無線寬頻帳號-PWLAN",
]

CAMP = {
    "ADSL": "TELCO",
    "FTTX": "TELCO",
    "CABLE_MODEM": "CABLE",
    "LEASED_LINE": "EXCLUDED",
    "PWLAN": "EXCLUDED",
}

TECH_NAME = {
    "ADSL": "ADSL",
    "FTTX": "光纖（FTTX）",
    "CABLE_MODEM": "Cable Modem",
    "LEASED_LINE": "固接專線",
    "PWLAN": "PWLAN",
}

COMPARABLE = ("ADSL", "FTTX", "CABLE_MODEM")

EXPECTED_LIVE = dict(rows=88, first=(2019, 1), last=(2026, 4), live=True)
EXPECTED_FROZEN = dict(rows=164, first=(2007, 1), last=(2020, 8), live=False)

CUTOVER = (2019, 1)
TOLERANCE = 0.001        # subtotal relative tolerance (0.1 %)
THRESHOLD_PCT = 5.0      # splice abandoned when median overlap diff exceeds this
ROC_OFFSET = 1911        # Gregorian year = ROC year + 1911
MA_WINDOW = 12           # trailing average length, NULL before it is full

GROUND_TRUTH = {
    "2019-01": dict(telco=4_296_061, cable=1_403_819, share=75.37),
    "2026-04": dict(telco=4_872_796, cable=2_469_678, share=66.36),
}
GROUND_TRUTH_DELTA_PP = -9.01
SHARE_TOLERANCE = 0.005

# scale generator: accounts = (epoch_days*7 + r*131 + o*17 + len(code)*991) % 500000
SCALE_REGIONS = 22
SCALE_MOD = 500_000

# ---------------------------------------------------------------------------
# Spec types
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SumSpec:
    total: str
    parts: tuple[str, ...]


@dataclass(frozen=True)
class SourceSpec:
    """What one wide text source must look like.

    ``period_cols`` is either one ``ROC/month`` column or ``(roc_year, month)``.
    """

    tag: str
    source: str                      # provenance value written to the fact
    columns: tuple[str, ...]         # exact ordered header
    period_cols: tuple[str, ...]
    unpivot: dict[str, str]          # wide column -> category code
    sums: SumSpec | None
    rows: int
    first: tuple[int, int]
    last: tuple[int, int]
    live: bool

    @property
    def numeric_cols(self) -> list[str]:
        return [c for c in self.columns if c not in self.period_cols]


@dataclass(frozen=True)
class PanelSpec:
    """Category grouping, comparison set, cutover and threshold."""

    groups: dict[str, str]           # code -> group
    primary: str                     # numerator group of the share
    secondary: str
    comparable: tuple[str, ...]
    cutover: dt.date
    threshold_pct: float = THRESHOLD_PCT
    names: dict[str, str] = field(default_factory=dict)

    @property
    def p(self) -> str:
        return self.primary.lower()

    @property
    def s(self) -> str:
        return self.secondary.lower()


LIVE = SourceSpec(
    tag="7164", source=SRC_LIVE, columns=tuple(COLS_LIVE), period_cols=("年月",),
    unpivot=MAP_LIVE, sums=SumSpec(SUM_LIVE_TOTAL, tuple(SUM_LIVE_PARTS)),
    rows=EXPECTED_LIVE["rows"], first=EXPECTED_LIVE["first"], last=EXPECTED_LIVE["last"],
    live=True,
)
FROZEN = SourceSpec(
    tag="27953", source=SRC_FROZEN, columns=tuple(COLS_FROZEN), period_cols=("年度", "月份"),
    unpivot=MAP_FROZEN, sums=SumSpec(SUM_FROZEN_TOTAL, tuple(SUM_FROZEN_PARTS)),
    rows=EXPECTED_FROZEN["rows"], first=EXPECTED_FROZEN["first"], last=EXPECTED_FROZEN["last"],
    live=False,
)
BROADBAND = PanelSpec(
    groups=CAMP, primary="TELCO", secondary="CABLE", comparable=COMPARABLE,
    cutover=dt.date(*CUTOVER, 1), names=TECH_NAME,
)
