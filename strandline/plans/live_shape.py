"""Which SELECTs a subscription may have, and their parts."""

from __future__ import annotations

from .tokens import Cursor, SqlError


def live_parts(sql: str) -> tuple[str, list[str], str | None]:
    """Table, columns and predicate of ``SELECT cols FROM table [WHERE ...]``; anything else is refused."""
    c = Cursor(sql.strip().rstrip(";"))
    if not c.accept("SELECT"):
        raise SqlError("a subscription takes one SELECT")
    if c.peek() and c.peek().upper == "DISTINCT":
        raise SqlError("a subscription takes no DISTINCT")
    columns: list[str] = []
    while True:
        if c.accept("*"):
            columns.append("*")
        else:
            columns.append(c.ident())
        if not c.accept(","):
            break
    c.expect("FROM")
    if c.peek() and c.peek().text == "(":
        raise SqlError("a subscription reads one table")
    ns, name = c.qualified()
    where = None
    if c.accept("WHERE"):
        depth = 0
        for t in c.tokens[c.at :]:
            depth += (t.text == "(") - (t.text == ")") if t.kind == "op" else 0
            if depth == 0 and t.upper in ("ORDER", "LIMIT", "GROUP", "HAVING", "UNION", "INTERSECT", "EXCEPT", "OFFSET", "WINDOW"):
                raise SqlError(f"a subscription takes no {t.upper}")
            if t.upper == "SELECT":
                raise SqlError("a subscription takes no subquery")
        where = c.rest()
        if not where:
            raise SqlError("WHERE without a predicate")
    elif c.peek() is not None:
        raise SqlError(f"a subscription takes no {c.peek().text}")
    return (f"{ns}.{name}" if ns else name), ([] if "*" in columns else columns), where
