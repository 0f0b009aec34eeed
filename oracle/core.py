"""Text helpers for the oracle statements: named relations and a few shorthand macros."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-02'"

# Shorthand -> template; {0}, {1} are the arguments.
MACROS = {
    # Half away from zero on the decimal value.
    "RND": "CAST(ROUND(CAST({0} AS DECIMAL(28,8)), {1}) AS DOUBLE)",
    "LNG": "CAST(ROUND(CAST({0} AS DECIMAL(28,8)), 0) AS BIGINT)",
    # Money: exact sums of whole cents.
    "CENTS": "CAST(SUM(CAST(ROUND(({0}) * 100) AS BIGINT)) AS BIGINT)",
    "MSUM": "(CENTS({0}) / 100.0)",
    "MAVG": "(MSUM({0}) / COUNT({0}))",
    "DIV": "(CAST({0} AS DOUBLE) / NULLIF(CAST({1} AS DOUBLE), 0))",
    "DAYS": "date_diff('day', CAST({1} AS DATE), CAST({0} AS DATE))",
    "MONTHS": "date_diff('month', CAST({1} AS DATE), CAST({0} AS DATE))",
    "ISUM": "CAST(SUM({0}) AS BIGINT)",
    "YES": "COUNT(*) FILTER (WHERE {0})",
    "RATE": "RND(COUNT(*) FILTER (WHERE {0}) * 100.0 / COUNT(*), 2)",
    "AVGR": "RND(AVG({0}), {1})",
    "TOT": "RND(MSUM({0}), 2)",
    "MEAN": "RND(MAVG({0}), 2)",
    "SHARE": "RND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2)",
    "TSHARE": "RND(MSUM({0}) * 100.0 / SUM(MSUM({0})) OVER (), 2)",
    "CORR2": "(covar_pop({0}, {1}) / NULLIF(stddev_pop({0}) * stddev_pop({1}), 0))",
}
_CALL = re.compile(r"\b(" + "|".join(MACROS) + r")\(")


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of the call whose opening bracket is just before ``start``."""
    depth, args, current, quoted = 1, [], "", False
    for i in range(start, len(text)):
        ch = text[i]
        if ch == "'":
            quoted = not quoted
        if not quoted:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    return [*args, current.strip()], i + 1
            elif ch == "," and depth == 1:
                args.append(current.strip())
                current = ""
                continue
        current += ch
    raise ValueError(f"unbalanced call in: {text[start:start + 80]}")


def expand(sql: str) -> str:
    while match := _CALL.search(sql):
        args, end = _arguments(sql, match.end())
        sql = sql[: match.start()] + MACROS[match.group(1)].format(*args) + sql[end:]
    return sql


RELATIONS: dict[str, str] = {}


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql.strip()


def statement(sql: str) -> str:
    """Puts the named relations that ``sql`` reads in front of it."""
    words = re.compile(r"\b[a-z_][a-z0-9_]*\b")
    ordered: list[str] = []

    def visit(text: str, inside: str | None) -> None:
        for word in words.findall(text):
            if word in RELATIONS and word != inside and word not in ordered:
                visit(RELATIONS[word], word)
                if word not in ordered:
                    ordered.append(word)

    visit(sql, None)
    head = ",\n".join(f"{n} AS (\n{RELATIONS[n]}\n)" for n in ordered)
    sql = sql.strip()
    if not head:
        return expand(sql)
    if sql.upper().startswith("WITH "):
        return expand(f"WITH {head},\n{sql[5:]}")
    return expand(f"WITH {head}\n{sql}")
