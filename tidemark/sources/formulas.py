"""Soft-sensor formula texts and their translation to Spark expressions.

Formulas hold only numbers, tags, parentheses and + - x /.  Anything else is refused before Spark's own parser
reads the text, and every division, at any depth, gets a denominator that is NULL near zero.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C

# Published engineering dependencies by model id.
FORMULAS = {
    "AVT6:240-350:D15": "791.22872 - 5.30294*(F65/(F32+F30)) + 0.52755*T66 - 0.15629*T33",
    "AVT6:240-350:T50": "283.177 - 0.01685*F7 + 0.06248*F30 + 0.22048*F34 - 0.25816*F45 - 0.12159*F59 + 0.01221*F63",
    "AVT6:240-350:CFPP": "31.40363 - 0.06784*T33 + 17.411*P67 - 8.11544*P4 - 0.47309*F65/(F32+F30)",
    "AVT6:240-350:EBP": "813.883 + 2.66463*F30 - 0.20239*T33 - 3.65888*F36 - 14.08235*T37 - 1.32603*T40 + 14.60206*T58",
    "AVT6:350-500:ViscosityK": "5.831 + 0.00976*T6 + 0.01188*T13 + 0.00224*T18 + 0.01905*T20 + 0.00794*L43 - 0.02496*T48 - 0.00008*P50 - 0.00882*F53 - 0.00394*P51 - 0.00255*F59 + 0.01153*T61",
    "AVT6:350:CFPP": "19.27111 - 0.10582*T48 + 0.13836*T40 - 0.42304*F31/F57",
    "AVT6:350:T50": "493.6798 + 1.281193*T42 - 0.955342*T48 - 0.018454*F31 + 0.265904*F57 - 0.082047*T66 - 0.545083*T33",
    "AVT6:350:I350": "39.562 - 1.62865*L43 + 0.76664*T6 - 0.22361*T18 + 0.00031*F64*(T15-T11)",
    "AVT6:350:D15": "983.092 + 0.27467*T42 - 0.49014*T48 - 0.32983*F31/F57",
    "24-2000:GODT:T90": "162.998 + 0.12945*T12 + 59.57*(F15/2000) + 0.00036*W7 + 0.26366*T23 - 424.72638*F1/F26",
    "24-2000:GODT:T50": "44.625 + 10.0224*P13 + 0.06981*F9 + 0.471*T6",
    "24-2000:GODT:I250": "84.585 - 0.21172*T5 + 0.12137*T11 - 0.00014*F25 + 0.56248*F14 - 0.16317*T23 + 0.20272*T16",
    "24-2000:GODT:D15": "667.881 + 0.15417*LIMS.D15 + 0.00005*F22 + 0.10774*T11",
    "24-2000:GODT:CloudPoint": "0.0002*F22 + 0.0021*W7 + 0.00008*F25 - 0.30656*F1 + 0.12018*T6 + 0.01916*F9 - 48.254 - 0.05249*T16 + 0.00011",
    "24-2000:GODT:CFPP": "0.22088*T23 - 102.375 - 47.75834*P8 + 0.03862*F9 + 43.60207*W7 + 43.81849*P24",
    "24-2000:GODT:T95": "0.03814*F9 - 9.201 - 0.00002*F2 + 0.50*T6 + 0.48321*LIMS.95%.T",
    "24-2000:GODT:IBP": "137.762 - 0.0653*F26 + 0.00011*F22 + 5.78137*P13 - 34.58028*P24 - 0.00993*F14 - 0.99962*W4 + 0.32232*T23 - 0.09406*T16",
}

TAG = r"[A-Z][A-Za-z]*\d+[A-Za-z0-9]*"
TOKEN = re.compile(rf"\s*(?:(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![A-Za-z0-9_.]))|(?P<tag>{TAG}(?![A-Za-z0-9_.]))|(?P<sign>[-+*/()]))")
NEAR_ZERO = 1e-9


def normalized(text: str) -> str:
    """Decimal comma and the multiplication signs in use become plain arithmetic; laboratory names become tags."""
    out = text.replace("−", "-").replace("×", "*").replace(",", ".")
    out = re.sub(r"LIMS\.([A-Za-z0-9%.]+)", lambda m: "L" + re.sub(r"\W", "", m[1]) + "0", out)
    return re.sub(r"(?<=[\d)\s])x(?=[\s(A-Z\d])", "*", out)


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text) pairs; anything but numbers, tags, parentheses and + - * / raises."""
    text, at, out = normalized(text).rstrip(), 0, []
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"only numbers, tags, parentheses and + - * / are allowed: {text[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def tags(text: str) -> list[str]:
    return list(dict.fromkeys(x for kind, x in tokens(text) if kind == "tag"))


ATOM = rf"(?:[-+]\s*)*(?:\d[\w.]*(?:e[+-]?\d+)?D|`[^`]+`|(?P<group>\((?:[^()]++|(?&group))*+\)))"
DIVISION = regex.compile(rf"/\s*(?P<below>{ATOM})")


def guarded(text: str) -> str:
    """Spark text in which every denominator, at any depth, is NULL where it is nearly zero."""
    def one(m) -> str:
        below = guarded(m["below"])
        return f"/ if(abs({below}) >= {NEAR_ZERO}D, {below}, NULL)"
    return DIVISION.sub(one, text)


def check_order(parts: list[tuple[str, str]]) -> None:
    """Operands and operators take turns and parentheses are closed, so that Spark takes nothing for an alias, a call or a comment."""
    depth, operand = 0, True
    for kind, x in parts:
        if operand and kind == "sign" and x in ")*/":
            raise ValueError(f"a number, a tag or a parenthesis is missing before {x!r}")
        if not operand and (kind != "sign" or x == "("):
            raise ValueError(f"an operator is missing before {x!r}")
        depth += (x == "(") - (x == ")")
        if depth < 0:
            raise ValueError("a parenthesis is closed twice")
        operand = kind == "sign" and x != ")"
    if operand or depth:
        raise ValueError("the formula ends too early")


def as_expression(text: str, inputs: Mapping[str, str]) -> Column:
    """The formula read by Spark: numbers as doubles, tags as quoted columns, denominators guarded."""
    parts = tokens(text)
    check_order(parts)
    spark = {"number": lambda x: f"{x}D", "tag": lambda x: f"`{inputs[x]}`", "sign": lambda x: x}
    return F.expr(guarded(" ".join(spark[kind](x) for kind, x in parts)))


def evaluate(text: str, inputs: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """(value, status) of a formula over columns named like its tags (or mapped by ``inputs``).

    Status: ok, missing_input, zero_denominator or not_finite; the value is NULL unless ok.
    """
    names = tags(text)
    inputs = {t: t for t in names} | dict(inputs or {})
    value = as_expression(text, inputs)
    have = reduce(lambda a, b: a & b, [F.col(f"`{inputs[t]}`").isNotNull() for t in names], F.lit(True))
    raw = C.finite(F.when(have, value))
    # With all inputs there, only a guarded denominator gives NULL.
    status = F.when(~have, "missing_input").when(value.isNull(), "zero_denominator").when(raw.isNull(), "not_finite").otherwise("ok")
    return raw, status
