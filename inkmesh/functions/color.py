"""Colour palettes and contrast."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The palettes, each as changes of the first.
PALETTE = {
    "dark_node": "#7aa2f7",
    "light_node": "#2457a6",
    "dark_line": "#414868",
    "light_line": "#9aa5b1",
    "dark_text": "#c0caf5",
    "light_text": "#334155",
    "dark_unresolved": "#f7768e",
    "light_unresolved": "#b42318",
    "dark_tag": "#bb9af7",
    "light_tag": "#6941c6",
    "dark_attachment": "#73daca",
    "light_attachment": "#087f5b",
    "dark_highlight": "#e0af68",
    "light_highlight": "#b54708",
}
NORD = {
    "dark_node": "#88c0d0",
    "light_node": "#2e3440",
    "dark_line": "#4c566a",
    "light_line": "#d8dee9",
    "dark_text": "#eceff4",
    "light_text": "#2e3440",
    "dark_unresolved": "#bf616a",
    "light_unresolved": "#a94442",
    "dark_tag": "#b48ead",
    "light_tag": "#815b7b",
}
CATPPUCCIN = {
    "dark_node": "#89b4fa",
    "light_node": "#1e66f5",
    "dark_line": "#585b70",
    "light_line": "#9ca0b0",
    "dark_text": "#cdd6f4",
    "light_text": "#4c4f69",
    "dark_unresolved": "#f38ba8",
    "light_unresolved": "#d20f39",
    "dark_tag": "#cba6f7",
    "light_tag": "#8839ef",
}
PALETTES = {"default": PALETTE, "nord": PALETTE | NORD, "catppuccin": PALETTE | CATPPUCCIN}
# The colour of a group by its kind, and the pairs whose contrast counts.
GROUP_COLORS = {"path": "dark_node", "tag": "dark_tag", "type": "dark_attachment", "status": "dark_highlight", "health": "dark_unresolved"}
TEXT_PAIRS = [("dark_text", "dark_node"), ("light_text", "light_node"), ("dark_node", "dark_unresolved"), ("light_node", "light_unresolved")]
NODE_PAIRS = [("dark_node", "dark_tag"), ("dark_node", "dark_attachment"), ("light_node", "light_tag"), ("light_node", "light_attachment")]
HEX = re.compile(r"#[0-9a-fA-F]{6}")


def palette(name: str = "default") -> dict[str, str]:
    if name not in PALETTES:
        raise ValueError(f"unknown theme {name!r}; there are {', '.join(PALETTES)}")
    return dict(PALETTES[name])


def group_palette(name: str = "default") -> dict[str, str]:
    colors = palette(name)
    return {kind: colors[key] for kind, key in GROUP_COLORS.items()}


def check_colors(colors: Mapping[str, object], needed: set[str] = frozenset()) -> None:
    """Raise on unknown or missing keys and on anything but #RRGGBB."""
    for what, keys in (("unknown", set(colors) - set(PALETTE)), ("missing", set(needed) - set(colors))):
        if keys:
            raise ValueError(f"{what} color keys: {', '.join(sorted(keys))}")
    wrong = sorted(k for k, v in colors.items() if not (isinstance(v, str) and HEX.fullmatch(v)))
    if wrong:
        raise ValueError(f"not #RRGGBB: {', '.join(wrong)}")


def luminance(hex_color: Column) -> Column:
    """WCAG relative luminance of #RRGGBB."""

    def channel(at: int) -> Column:
        v = F.conv(F.substring(hex_color, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return channel(2) * 0.2126 + channel(4) * 0.7152 + channel(6) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return F.round((F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05), 2)


def contrast_checks(spark: SparkSession, colors: Mapping[str, str], minimum: float = 2.0, conflicts: bool = True) -> DataFrame:
    """(kind, first, second, ratio, ok) of the pairs that should differ."""
    if isinstance(minimum, bool) or not isinstance(minimum, (int, float)) or not math.isfinite(minimum) or minimum < 1:
        raise ValueError("minimum contrast must be a finite number of at least 1")
    pairs = [("check", a, b) for a, b in TEXT_PAIRS] + [("conflict", a, b) for a, b in NODE_PAIRS if conflicts]
    check_colors(colors, {k for _, *ab in pairs for k in ab})
    rows = spark.createDataFrame([(k, a, b, colors[a], colors[b]) for k, a, b in pairs], "kind string, first string, second string, a string, b string")
    out = rows.withColumn("ratio", contrast(F.col("a"), F.col("b")))
    return out.select("kind", "first", "second", "ratio", (F.col("ratio") >= float(minimum)).alias("ok"))


def theme_report(spark: SparkSession, colors: Mapping[str, str], minimum: float = 2.0) -> dict:
    """One object: the minimum, whether all pairs reach it, and the pairs that were checked and that may conflict."""
    rows = [r.asDict() for r in contrast_checks(spark, colors, minimum).collect()]
    part = lambda kind: [{k: v for k, v in r.items() if k != "kind"} for r in rows if r["kind"] == kind]
    return {"minimum_contrast": minimum, "ok": all(r["ok"] for r in rows), "checks": part("check"), "conflicts": part("conflict")}


def render_css(colors: Mapping[str, str]) -> str:
    """Style sheet with one block for each mode."""
    check_colors(colors, set(PALETTE))
    names = {"node": "fill", "line": "line", "text": "text", "unresolved": "fill-unresolved", "tag": "fill-tag", "attachment": "fill-attachment", "highlight": "fill-highlight"}
    blocks = []
    for mode in ("dark", "light"):
        own = lambda css: f".theme-{mode} .graph-view.color-{css}"  # noqa: E731, B023
        rules = [f"{own(css)} {{ color: {colors[f'{mode}_{key}']}; }}" for key, css in names.items()]
        rules.append(f"{own('line-highlight')} {{ color: {colors[f'{mode}_highlight']}; }}")
        blocks.append("\n".join(rules))
    return "\n\n".join(blocks) + "\n"
