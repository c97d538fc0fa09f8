"""Queries on accounting statements: Spark reads the tables out of the written statements, SQL starts from the charges."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import statements
from docspark.plans.storage import written
from docspark.queries import _register

_SUMS = """s as (select unit, year, count(*) as n, sum(cents)::bigint as cents, sum(water)::bigint as water, sum((cents + water) // 2)::bigint as half from v_charges group by 1, 2),
  t as (select *, case when unit % 8 < 2 then 'R' when unit % 8 < 4 then 'B' when unit % 8 < 6 then 'E' else 'P' end as title, unit % 2 = 0 as split, unit % 3 <> 0 as budget, cents + water + case when unit % 7 = 0 then 100 else 0 end as balance, cents + water + case when unit % 5 = 0 then 100 else 0 end as due from s)"""
_ROLES = """r as (select *, case when split then 'actual_allocation' when title = 'R' then 'actual_allocation' when title = 'B' then 'budget_allocation' end as role1,
  case when budget then 'budget_summary' when split then 'actual_allocation' when title = 'R' then 'actual_summary' when title = 'B' then 'budget_summary' end as role2 from t)"""


@_register(f"""with {_SUMS} select unit, case when title = 'R' and (budget or split) then 'rendiconto_composito' when title = 'R' then 'rendiconto' when title = 'B' and not split then 'bilancio_preventivo' when split then 'riparto_spese' when title = 'E' then 'estratto_contabile' else 'unknown' end as statement_type,
  concat(year - 1, '-07-01') as period_from, concat(year, '-06-30') as period_to from t""")
def fn_statement_type(v):
    """Kind and first period of each statement, from its text."""
    period = statements.statement_period(F.col("text"))
    return v("statements").select("unit", statements.statement_type(F.col("text")).alias("statement_type"), period[0].alias("period_from"), period[1].alias("period_to"))


_TABLES = f"""with {_SUMS}, {_ROLES}, x as (
  select unit, 0 as position, 'table_1' as table_id, 'expense_allocation' as table_type, role1 as role, concat(year - 1, '-07-01') as period_from, concat(year, '-06-30') as period_to, 'preceding_section' as period_source, n + 1 as n_rows, 'Unita|Nominativo|Spese generali|Acqua|Quota mill.|Totale gestione' as headers from r
  union all select unit, 1, 'table_2', 'summary', role2, concat(year, '-07-01'), concat(year + 1, '-06-30'), 'preceding_section', 2, 'Voce|Importi' from r
  union all select unit, 2, 'html_1', 'payment_schedule', 'budget_installment_schedule', concat(year - 1, '-07-01'), concat(year, '-06-30'), 'document_unit', n + 1, 'Nominativo|Rata n. 1|Rata n. 2|Totale dovuto' from r
  union all select unit, 3, 'grid_1', 'summary', null, concat(year - 1, '-07-01'), concat(year, '-06-30'), 'document_unit', 2, 'Voce|Importi' from r)"""


def _listed(v, source, column):
    # only the column that holds such tables is read, and of them neither role nor period
    only = [(F.col(c) if c == column else F.lit(None).cast("string")).alias(c) for c in ("text", "html", "grid")]
    df = statements.tables(v("statements").select("unit", *only), about=False).where(F.col("source") == source)
    return df.select("unit", "table_id", "table_type", F.array_join("headers", "|").alias("headers"), F.size("lines").cast("long").alias("n_rows"), F.round(F.aggregate(F.flatten(F.transform("lines", lambda r: r["amounts"])), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))) * 1000).cast("long").alias("thousandths"))


@_register(f"""{_TABLES}, p as (select unit, sum(line * 10 + 5)::bigint as mill from v_charges group by 1)
  select x.unit, table_id, table_type, headers, n_rows, case table_id when 'table_1' then 40 * (cents + water) + mill else 20 * ((cents + water) // 2) end as thousandths from x join r on x.unit = r.unit join p on x.unit = p.unit where table_id like 'table_%'""")
def udtf_markdown_table(v):
    """Pipe tables of statements: headers, lines and all their amounts."""
    return _listed(v, "markdown", "text")


@_register(f"""{_TABLES} select x.unit, table_id, table_type, headers, n_rows, 10 * (3 * (cents + water) + due) as thousandths from x join r on x.unit = r.unit where table_id = 'html_1'""")
def udtf_html_table(v):
    """HTML tables of statements."""
    return _listed(v, "html", "html")


@_register(f"""{_TABLES} select x.unit, table_id, table_type, headers, n_rows, 10 * (cents + water + balance) as thousandths from x join r on x.unit = r.unit where table_id = 'grid_1'""")
def udtf_grid_table(v):
    """Tables of statements given as cells with spans."""
    return _listed(v, "grid", "grid")


@_register(f"{_TABLES} select unit, table_id, role, period_from, period_to, period_source from x")
def win_section_context(v):
    """Role and period of each table, from the last phrase and period before it."""
    return statements.tables(v("statements"), amounts=False).select("unit", "table_id", "role", "period_from", "period_to", "period_source")


@_register(f"""{_TABLES}, y as (select *, coalesce(role, case table_type when 'expense_allocation' then 'allocation' else table_type end) as section_role from x)
  select unit, section_role as role, row_number() over (partition by unit order by min(position)) as section, array_to_string(list_filter(list(table_type order by position), lambda x, i: list_position(list(table_type order by position), x) = i), ',') as table_types, array_to_string(list(table_id order by position), ',') as table_ids, count(*) as table_count, sum(n_rows)::bigint as row_count from y group by 1, 2""")
def agg_statement_sections(v):
    """Tables of a statement by role, in order of the first of each."""
    df = statements.sections(statements.tables(v("statements"), amounts=False))
    return df.select("unit", "role", "section", F.array_join("table_types", ",").alias("table_types"), F.array_join("table_ids", ",").alias("table_ids"), "table_count", "row_count")


@_register(f"""with {_SUMS}, x as (
  select unit, 'table_1' as table_id, unnest(['Totale', 'Spese generali', 'Acqua', 'Totale gestione']) as name, unnest([cents + water, cents, water, cents + water]) as cents from t
  union all select unit, 'table_2', unnest(['Totale gestione', 'Importi', 'Saldo finale']), (cents + water) // 2 from t
  union all select unit, 'html_1', unnest(['Totale', 'Rata n. 1', 'Rata n. 2', 'Totale dovuto']), unnest([due, half, cents + water - half, due]) from t
  union all select unit, 'grid_1', unnest(['Totale gestione', 'Importi', 'Saldo finale']), unnest([cents + water, balance, balance]) from t) select * from x""")
def agg_table_totals(v):
    """Totals of each table, of the lines marked as such; the last one stands."""
    df = statements.totals(statements.tables(v("statements"), about=False))
    return df.select("unit", "table_id", F.explode("totals").alias("t")).select("unit", "table_id", "t.name", F.round(F.col("t.amount") * 100).cast("long").alias("cents"))


@_register(f"""with {_SUMS}, x as (select unit, 'summary_total_matches_balance' as check_type, 'table_2' as table_id, 'pass' as status from t
  union all select unit, 'summary_total_matches_balance', 'grid_1', case when balance = cents + water then 'pass' else 'fail' end from t
  union all select unit, 'allocation_totals_extracted', 'table_1', 'pass' from t
  union all select unit, 'installment_sum_matches_total_due', 'html_1', case when due = cents + water then 'pass' else 'fail' end from t
  union all select unit, 'statement_total_matches_payment_schedule', null, case when due = balance then 'pass' else 'fail' end from t) select * from x""")
def agg_validation_checks(v):
    """The numeric checks on each statement's tables."""
    # parsed once, read by every check
    found = written(statements.tables(v("statements")), "statement-tables")
    return statements.checks(found).select("unit", "check_type", "table_id", "status")


_FACTS = f"""{_TABLES}, c as (select *, row_number() over (partition by unit order by line, cents, water) as row_no from v_charges), f as (
  select c.unit, 'table_1' as table_id, row_no, concat('A', line) as unit_code, concat('Condomino ', upper(segment[1]), lower(segment[2:])) as subject, 'allocated_expense' as fact_type, unnest(['Spese generali', 'Acqua', 'Totale gestione']) as category, unnest([false, false, true]) as is_total, unnest([cents, water, cents + water]) as cents from c
  union all select c.unit, 'html_1', row_no, concat('A', line), concat('Condomino ', upper(segment[1]), lower(segment[2:]), case when line % 3 = 0 then ' Srl' else '' end), unnest(['installment_due', 'installment_due', 'amount_due']), unnest(['Rata n. 1', 'Rata n. 2', null]), unnest([false, false, true]), unnest([(cents + water) // 2, cents + water - (cents + water) // 2, cents + water]) from c),
  g as (select f.*, row_number() over (partition by f.unit, f.table_id, row_no, fact_type, category) as nth, x.role as accounting_role, period_from, period_to, period_source from f join x on f.unit = x.unit and f.table_id = x.table_id where cents > 0)"""


@_register(f"{_FACTS} select unit, table_id, unit_code, subject, fact_type, category, is_total, cents, accounting_role, period_from, period_to, period_source from g")
def fn_row_facts(v):
    """Facts of every account line: one for each amount whose column says what it is."""
    df = statements.facts(statements.tables(v("statements")))
    return df.select("unit", "table_id", "unit_code", "subject", "fact_type", "category", "is_total", F.round(F.col("amount") * 100).cast("long").alias("cents"), "accounting_role", "period_from", "period_to", "period_source")


@_register(f"""{_FACTS}, a as (select unit, lower(unit_code) as account_key, subject, count(distinct (table_id, row_no)) as n, count(*) as k, min(unit_code) as unit_code from g group by 1, 2, 3)
  select unit, account_key, min(unit_code) as unit_code, arg_max(subject, (n, length(subject), subject)) as subject, array_to_string(list(subject order by subject), '|') as aliases, sum(k)::bigint as n_facts from a group by 1, 2""")
def agg_accounts(v):
    """Accounts of each statement with their names and number of facts."""
    df = statements.accounts(statements.facts(statements.tables(v("statements"), about=False)))
    return df.select("unit", "account_key", "unit_code", "subject", F.array_join("aliases", "|").alias("aliases"), "n_facts")


@_register(f"{_TABLES} select table_type, headers, count(*) as n from x group by 1, 2")
def fn_table_type(v):
    """What kind of table its headers and first lines make it."""
    return statements.tables(v("statements"), about=False, amounts=False).groupBy("table_type", F.array_join("headers", "|").alias("headers")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"{_FACTS} select unit, unit_code, subject, count(*) as n_lines from (select distinct unit, unit_code, subject, table_id, row_no from g) group by 1, 2, 3")
def fn_account_identity(v):
    """Code and name of the account a line is about."""
    rows = statements.facts(statements.tables(v("statements"), about=False)).select("unit", "unit_code", "subject", "table_id", "row_no").distinct()
    return rows.groupBy("unit", "unit_code", "subject").agg(F.count(F.lit(1)).alias("n_lines"))


@_register(f"""with {_SUMS} select unit, least(0.97, round(0.45 + 0.12 + 0.1 + 0.05 * 4, 4))::double as confidence, (balance <> cents + water)::int + (due <> cents + water)::int + (due <> balance)::int as failed, concat_ws(',', case when balance <> cents + water or due <> cents + water or due <> balance then 'failed_checks' end) as reasons from t""")
def agg_statement_quality(v):
    """How far a statement can be trusted: failed checks, unknown tables, no facts, columns without a name."""
    found = written(statements.tables(v("statements")), "statement-tables")
    failed = statements.checks(found).groupBy("unit").agg(F.count_if(F.col("status") == "fail").cast("int").alias("failed"))
    facts = statements.facts(found).groupBy("unit").agg(F.count(F.lit(1)).alias("n_facts"))
    shape = found.groupBy("unit").agg(F.count(F.lit(1)).alias("n_tables"), F.bool_or(F.col("table_type") == "unknown").alias("unknown"), F.bool_or(F.exists("headers", lambda h: h.rlike("^column_[0-9]+$"))).alias("unnamed"))
    df = shape.join(failed, "unit").join(facts, "unit", "left").na.fill(0, ["n_facts"])
    reasons = F.concat_ws(",", F.when(F.col("failed") > 0, "failed_checks"), F.when(F.col("unknown"), "unknown_table"), F.when(F.col("n_facts") == 0, "no_facts"), F.when(F.col("unnamed"), "unnamed_columns"))
    confidence = F.least(F.lit(0.97), F.round(0.45 + F.when(F.col("n_facts") > 0, 0.12).otherwise(0) + F.when(~F.col("unknown"), 0.1).otherwise(0) + 0.05 * F.col("n_tables"), 4))
    return df.select("unit", confidence.alias("confidence"), "failed", reasons.alias("reasons"))
