"""Number and date formats of spreadsheet cells, applied to the numbers as a reader of the sheet sees them.

A format has up to four sections (positive; negative; zero; text). Dates, times, elapsed
hours, decimals, thousands, percentages and exponents are formatted; colours, conditions,
fill and alignment signs fall away. Fractions are shown as plain numbers.
"""

from __future__ import annotations

import datetime
import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

# The built-in formats of the file format by their numbers.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}

_PART = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[(h+|m+|s+)\]|\[[^\]]*\]|(AM/PM|A/P)|([yY]+|[mM]+|[dD]+|[hH]+|[sS]+)|(\.0+)|(.)', re.S)
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


@lru_cache(1000)
def _sections(code: str) -> tuple[str, ...]:
    return tuple(re.findall(r'(?:"[^"]*"|\\.|[^;"\\])*', code)[::2]) if '"' in code or "\\" in code else tuple(code.split(";"))


@lru_cache(1000)
def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]|_.|\*.|E[+-]', "", code.split(";")[0], flags=re.I)
    return "general" not in bare.lower() and bool(re.search(r"[ymdhs]", bare, re.I))


def _date(serial: float, code: str, base: datetime.datetime) -> str:
    parts = [m.groups() for m in _PART.finditer(code)]
    kinds = [(p[2] or p[4] or "").lower()[:1] for p in parts]
    half = any(p[3] for p in parts)
    fraction = next((len(p[5]) - 1 for i, p in enumerate(parts) if p[5] and "s" in kinds[:i]), 0)
    step = Decimal(10) ** -fraction
    seconds = (Decimal(repr(serial)) * 86400).quantize(step, ROUND_HALF_UP)
    at = base + datetime.timedelta(microseconds=int(seconds * 1_000_000))
    out = []
    for i, (quoted, escaped, elapsed, day_half, unit, tail, other) in enumerate(parts):
        if quoted is not None or escaped is not None:
            out.append(quoted if quoted is not None else escaped)
        elif elapsed:
            whole = int(seconds) // {"h": 3600, "m": 60, "s": 1}[elapsed[0]]
            out.append(str(whole).zfill(len(elapsed)))
        elif day_half:
            name = "AM" if at.hour < 12 else "PM"
            out.append(name if day_half == "AM/PM" else name[0])
        elif tail is not None:
            out.append(f"{seconds % 1:f}"[1 : 1 + len(tail)] if "s" in kinds[:i] else tail)
        elif unit:
            n, k = len(unit), unit[0].lower()
            before = next((x for x in reversed(kinds[:i]) if x), "")
            after = next((x for x in kinds[i + 1 :] if x), "")
            if k == "m" and n <= 2 and (before == "h" or after == "s"):
                out.append(str(at.minute).zfill(n))
            elif k == "m":
                out.append(str(at.month).zfill(n) if n <= 2 else _MONTHS[at.month - 1][: {3: 3, 5: 1}.get(n)])
            elif k == "y":
                out.append(f"{at.year % 100:02d}" if n <= 2 else f"{at.year:04d}")
            elif k == "d":
                out.append(str(at.day).zfill(n) if n <= 2 else _DAYS[at.weekday()][: 3 if n == 3 else None])
            else:
                v = (at.hour % 12 or 12 if half else at.hour) if k == "h" else at.second
                out.append(str(v).zfill(min(n, 2)))
        elif other is not None:
            out.append(other)
    return "".join(out)


def _number(value: Decimal, code: str) -> str:
    body = re.sub(r"\[[^\]]*\]|_.|\*.", "", code)
    marks = re.sub(r'"[^"]*"|\\.', lambda m: "\x00" * len(m.group()), body)
    spot = re.search(r"[#0?][#0?,]*(?:\.[#0?]*)?(?:E[+-][#0?]+)?", marks, re.I)
    plain = lambda s: re.sub(r'"([^"]*)"|\\(.)', lambda m: m.group(1) if m.group(1) is not None else m.group(2), s)
    if not spot:
        return plain(body)
    digits = spot.group()
    head, _, power = digits.upper().partition("E")
    whole, _, decimals = head.partition(".")
    if "%" in marks:
        value *= 100
    scale = len(whole) - len(whole.rstrip(","))
    value /= Decimal(1000) ** scale
    if power:
        shift = value.adjusted() if value else 0
        shown = (value / Decimal(10) ** shift).quantize(Decimal(1).scaleb(-len(decimals)), ROUND_HALF_UP)
        if shown >= 10:
            shift, shown = shift + 1, (shown / 10).quantize(Decimal(1).scaleb(-len(decimals)), ROUND_HALF_UP)
        sign = "-" if shift < 0 else "+" if power[0] == "+" else ""
        text = f"{shown:f}E{sign}{str(abs(shift)).zfill(len(power) - 1)}"
    else:
        text = f"{value.quantize(Decimal(1).scaleb(-len(decimals)), ROUND_HALF_UP):f}"
        left, _, right = text.partition(".")
        optional = len(decimals) - len(decimals.rstrip("#"))
        while optional and right.endswith("0"):
            right, optional = right[:-1], optional - 1
        left = left.lstrip("0").zfill(whole.replace(",", "").count("0")) if left.strip("0") or whole.count("0") else ""
        if "," in whole.rstrip(","):
            left = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", left)
        text = f"{left}.{right}" if right else left
    return plain(body[: spot.start()]) + text + plain(body[spot.end() :])


def shown(text: str, code: str, date1904: bool = False) -> str:
    """A numeric cell's text under a format; text that is no number comes as it is."""
    try:
        value = Decimal(text)
    except ArithmeticError:
        return text
    parts = _sections(code)
    if is_date(code):
        base = datetime.datetime(1904, 1, 1) if date1904 else datetime.datetime(1899, 12, 30)
        try:
            return _date(float(value), parts[0], base)
        except (ArithmeticError, ValueError):  # beyond any date
            return text
    section = parts[1] if value < 0 and len(parts) > 1 and parts[1] else parts[2] if not value and len(parts) > 2 else parts[0]
    if section.strip().lower() in ("general", "@", "") or "/" in re.sub(r'"[^"]*"', "", section):
        return text
    sign = "-" if value < 0 and not (len(parts) > 1 and parts[1]) else ""
    return sign + _number(abs(value), section)
