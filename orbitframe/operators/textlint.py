"""Rule-based text linting of lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The rules, in order; what exempts a heading; the length of a snippet.
RULES = (
    (r"\w — \w|\w—\w", "em-dash in prose (use comma, colon, or split the sentence)"),
    (r"\w &mdash; \w|\w&mdash;\w|&mdash; \w|\w &mdash;", "em-dash entity in prose (use comma, colon, or split the sentence)"),
    (r"\bisn'?t just\b|\baren'?t just\b|\bnot just\b|\bmore than just\b", "antithesis tell: 'not just X'"),
    (r"\bIt'?s not about\b|\bwon'?t just\b|\bdoesn'?t just\b", "antithesis tell"),
    (r"\bdelve\b|\bseamless(ly)?\b|\bleverage[sd]?\b|\brobust\b|\btapestry\b", "banned AI word"),
    (r"\belevate\b|\bunlock\b|\bempower(s|ing)?\b|\bpivotal\b|\bfostering\b", "banned AI word"),
    (r"\btestament to\b|\bgame-chang|\bcutting-edge\b|\bworld-class\b|\bstate-of-the-art\b", "promo AI word"),
    (r"\bIt'?s important to note\b|\bIn conclusion\b|\bMoreover\b|\bFurthermore\b", "AI connective"),
    (r"\bIn summary\b|\bOverall,\b|\bUltimately,\b", "AI summary opener"),
)
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"  # white space of any kind
HEADING = r"<h[1-6][^>]*>|<title|og:title|twitter:title"
SNIPPET = 90


def portable(pattern: str) -> str:
    """The rule for matchers whose classes are ASCII: word characters spelled out, so that it means the same everywhere."""
    letter = r"[\p{L}\p{N}_]"
    pattern = re.sub(r"(^|\|)\\b", rf"\1(?:^|[^\\p{{L}}\\p{{N}}_])", pattern)
    pattern = re.sub(r",\\b", f",{letter}".replace("\\", r"\\"), pattern)  # after a comma only a letter makes a boundary
    pattern = pattern.replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")
    return re.sub(r"\\w", letter.replace("\\", r"\\"), pattern)


def lines_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line (from 1), raw."""
    return files.filter(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.posexplode(F.split(content, LINE_END)).alias("line", "raw")).withColumn("line", F.col("line") + 1)


def outside_style(lines: DataFrame) -> DataFrame:
    """Lines that no style block holds: a line with a closing tag goes, and so do those after the last opener."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.contains("raw", F.lit("<style")), F.contains("raw", F.lit("</style"))
    mark = F.when(closes, 0).when(opens, 1)
    state = F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0))
    return lines.withColumn("_in", state).filter((F.col("_in") == 0) & ~closes).drop("_in")


def findings(lines: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per line and rule that matches. The rules are literals, so no join is made."""
    text = F.regexp_replace("raw", "<[^>]+>", " ")
    heading = F.regexp_like("raw", F.lit(HEADING))
    tests = [F.when(F.regexp_like("text", F.lit(portable(p))) & ~(F.col("heading") & F.lit("em-dash" in m)), F.struct(F.lit(i).alias("rule"), F.lit(m).alias("message"))) for i, (p, m) in enumerate(rules)]
    found = lines.withColumn("text", text).withColumn("heading", heading).withColumn("hit", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    return found.select("path", "line", "hit.rule", "hit.message", F.substring(F.regexp_replace("text", f"^{BLANK}+|{BLANK}+$", ""), 1, SNIPPET).alias("snippet"))


def lint(files: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    return findings(outside_style(lines_of(files)), rules)


def exit_status(found: DataFrame) -> DataFrame:
    """One row: the number of findings, and 1 if there are any."""
    return found.agg(F.count(F.lit(1)).alias("findings")).withColumn("status", F.when(F.col("findings") > 0, 1).otherwise(0))
