"""All oracle statements by query name."""

from oracle import advanced, customer, financial, operational  # noqa: F401 - register relations
from oracle.analysis import ANALYSIS_SQL
from oracle.core import RELATIONS, statement
from oracle.reports import REPORT_SQL
from oracle.staging import STAGING


def statements() -> dict[str, str]:
    out = {name: statement(sql) for name, sql in STAGING.items()}
    for name in RELATIONS:
        if name.startswith("m_"):
            out[f"mart_{name[2:]}"] = statement(f"SELECT * FROM {name}")
    for name, sql in REPORT_SQL.items():
        out[f"rpt_{name}"] = statement(sql)
    for name, sql in ANALYSIS_SQL.items():
        out[name] = statement(sql)
    return out
