"""Markdown expressions: code, links, targets, headings. JVM-side except YAML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmesh.functions.text import newlines, percent_decode, strip_ws

# Link patterns; the groups hold text, bracketed target, plain target.
MD_LINK = r"(?<!!)\[([^\]\n]+)\]\((?:<([^>\n]+)>|([^)\n]+))\)"
WIKI_LINK = r"(?<!`)\[\[([^\]\n]+)\]\]"
ANY_WIKI_LINK = r"\[\[([^\]\n]+)\]\]"
PLAIN_MD_LINK = r"\[([^\]\n]+)\]\(([^)\n]+)\)"
FENCE = r"(?Umd)^[\s&&[^\n]]*(?:```|~~~)[^\n]*$"
SCHEME = r"^[a-z][a-z0-9+.\-]*:"
# Targets that stand for something else.
PLACEHOLDER = r"(?iUd)^(path|local_path|url|new_path|old_path|your-|example|todo|xxx|\$.*|\d+|\.+\.*|.*\*.*|.*<.*>.*)$"
# First folders of a web site's paths.
SITE_DIRS = (
    "categories",
    "category",
    "tags",
    "tag",
    "archives",
    "archive",
    "changelog",
    "start",
    "docs",
    "guide",
    "guides",
    "tutorial",
    "tutorials",
    "blog",
    "skills-market",
    "advanced",
    "uploads",
)


def strip_code(text: Column) -> Column:
    """Text without fenced blocks and inline code; the number of lines stays.

    Splitting at fence lines leaves outside and inside parts in turn, which is what a flag
    toggled by every fence line means.
    """
    parts = F.split(newlines(text), FENCE, -1)
    blank = lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, "[^\n]+", "")).otherwise(x)
    return F.regexp_replace(F.array_join(F.transform(parts, blank), ""), "`[^`\n]+`", " ")


def md_targets(text: Column) -> Column:
    """Raw targets of Markdown links, images left out."""
    two, three = (F.regexp_extract_all(text, F.lit(MD_LINK), F.lit(k)) for k in (2, 3))
    return F.zip_with(two, three, lambda a, b: F.when(a != "", a).otherwise(b))


def wiki_bodies(text: Column, pattern: str = WIKI_LINK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def graph_target(body: Column) -> Column:
    """Target of a wikilink for the graph: before any pipe, no embed mark, no fragment."""
    return F.substring_index(F.ltrim(strip_ws(F.substring_index(body, "|", 1)), F.lit("!")), "#", 1)


def scan_target(body: Column) -> Column:
    """Target of a wikilink for the scan: before the first unescaped pipe, escapes undone."""
    t = F.ltrim(strip_ws(F.element_at(F.split(body, r"(?<!\\)\|", 2), 1)), F.lit("!"))
    return F.replace(t, F.lit("\\|"), F.lit("|"))


def clean_target(raw: Column) -> Column:
    """Target without title, angle brackets, percent codes and fragment."""
    t = F.regexp_replace(strip_ws(raw), r"(?Us)^([^\s]+)\s+[\"'].*[\"']$", "$1")
    t = percent_decode(F.regexp_replace(t, r"(?s)^<(.*)>$", "$1"))
    return strip_ws(F.substring_index(t, "#", 1))


def slug(heading: Column) -> Column:
    """Anchor of a heading."""
    kept = F.regexp_replace(heading, r"(?U)[^\w\s\-]", "")
    return F.replace(F.lower(strip_ws(kept)), F.lit(" "), F.lit("-"))


def has_fragment(text: Column, fragment: Column) -> Column:
    """Whether a text holds a heading or a ^block with this name."""
    heads = F.regexp_extract_all(newlines(text), F.lit(r"(?md)^#+[ \t]+([^\n]+)$"), F.lit(1))
    block = F.regexp_extract_all(text, F.lit(r"(?U)\^([\w-]+)"), F.lit(1))
    return F.when(fragment.startswith("^"), F.array_contains(block, F.substring(fragment, F.lit(2), F.length(fragment)))).otherwise(
        F.exists(heads, lambda h: slug(h) == slug(fragment))
    )


def is_site_path(src: Column, target: Column) -> Column:
    """Paths of a web site rather than of the vault."""
    low = F.lower(target)
    any_dir = low.rlike("^/?(" + "|".join(SITE_DIRS) + ")/")
    own = src.startswith("30-reference/references/trellis/") & (low == "./custom-skills")
    return any_dir | own | (target.startswith("/") & low.rlike(r"\.html?$"))


def is_html_mirror(src: Column, target: Column) -> Column:
    low = F.lower(target)
    return ~low.startswith("/") & low.rlike(r"[^/]\.html?$") & src.startswith("30-reference/")
