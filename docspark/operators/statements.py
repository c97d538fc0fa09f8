"""Accounting statements: tables out of OCR text, HTML and cell grids, and the facts, totals, sections and checks in them.

A table is a row: unit, table_id, source, headers, lines (row_no, cells; amounts beside them), and the text before it. Tables
of a unit stay arrays of that unit's row until they are exploded, so parsing needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Lines with two pipes at least, one after another.
_BLOCK = r"(?m)(?:^[^\n|]*\|[^\n|]*\|[^\n]*(?:\n|\z))+"
_AMOUNT = r"^(?:-?\d{1,3}(?:\.\d{3})*(?:,\d+)?|-?\d+(?:,\d+)?)$"
_PERIOD = r"Periodo:\s*(\d{1,2}/\d{1,2}/\d{2,4})\s*-\s*(\d{1,2}/\d{1,2}/\d{2,4})"
#: Phrases before a table that tell its role, in order of preference.
ROLES = [
    ("budget_installment_schedule", r"rate\s+da\s+versare|scadenze\s+indicate"),
    ("actual_allocation", r"consuntivo\s+ripartizioni|riparto\s+(?:spese\s+)?consuntivo|ripartizioni\s+consuntivo"),
    ("budget_allocation", r"preventivo\s+ripartizioni|ripartizione\s+preventivo|riparto\s+(?:spese\s+)?preventivo|ripartizioni\s+preventivo"),
    ("budget_summary", r"bilancio\s+preventivo|preventivo\s+(?:di\s+)?gestione|preventivo\s+spese"),
    ("actual_summary", r"rendiconto|consuntivo\s+gestione|bilancio\s+consuntivo|situazione\s+patrimoniale"),
]
#: What a column's name says about its amounts (kind, is it a total).
COLUMNS = [
    ("totale dovuto", "amount_due", True),
    ("totale preventivo", "budgeted_expense", True),
    ("rata n.", "installment_due", False),
    ("quote a rimborso", "reimbursement", False),
    ("rate versate", "payment_received", True),
    ("saldo finale", "closing_balance", True),
    ("saldi di fine", "opening_balance", True),
    ("saldo iniziale", "opening_balance", True),
]
SIGNED = ["closing_balance", "opening_balance"]
GRID = "struct<num_rows:int,num_cols:int,table_cells:array<struct<start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int,text:string,column_header:boolean,row_header:boolean>>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often and in whatever lambdas ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def amount(value: Column) -> Column:
    """A whole cell as an Italian amount, null if it is anything else."""
    read = lambda bare: F.when(bare.rlike(_AMOUNT), F.translate(bare, ",.", ".").cast("double"))
    return once(F.translate(value, "€ ", ""), read)


def iso_date(value: Column) -> Column:
    """d/m/y, with two-digit years up to 49 in this century."""

    def iso(part: Column) -> Column:
        year = F.get(part, F.lit(2))
        full = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") < 50, "20").otherwise("19"), year)).otherwise(year)
        return F.concat(full, F.lit("-"), F.lpad(F.get(part, F.lit(1)), 2, "0"), F.lit("-"), F.lpad(F.get(part, F.lit(0)), 2, "0"))

    return once(F.split(value, "[/-]"), iso)


def statement_type(text: Column) -> Column:
    has = lambda *words: F.greatest(*(F.lower(text).contains(w) for w in words), F.lit(False))
    actual, budget = has("rendiconto", "bilancio consuntivo", "consuntivo gestione"), has("preventivo")
    split, rates = has("riparto", "ripartizioni", "ripartizione"), has("rate da versare", "scadenze indicate")
    return (
        F.when(actual & (budget | split | rates), "rendiconto_composito")
        .when(actual, "rendiconto")
        .when(has("bilancio preventivo") & ~split, "bilancio_preventivo")
        .when(split, "riparto_spese")
        .when(has("estratto contabile"), "estratto_contabile")
        .otherwise("unknown")
    )


def statement_period(text: Column, last: bool = False) -> list[Column]:
    """ISO ends of the first (or the last) period a text names; null without one."""
    both = []
    for group in (1, 2):
        found = F.regexp_extract_all(text, F.lit(("(?i)" if last else "") + _PERIOD), F.lit(group))
        both.append(iso_date(F.element_at(found, -1) if last else F.get(found, F.lit(0))))
    return both


def _nonblank(row: Column) -> Column:
    return F.exists(row, lambda x: F.trim(x) != "")


def pipe_grids(text: Column) -> Column:
    """Tables of pipes in a text: array of (source, table_id, grid, header_rows, skip, before)."""
    both = F.struct(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0)).alias("blocks"), F.split(text, _BLOCK, -1).alias("parts"))

    def table(block: Column, i: Column, blocks: Column, parts: Column) -> Column:
        lines = F.filter(F.split(block, "\r?\n"), lambda x: x != "")
        grid = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), F.trim))
        before = F.concat(F.array_join(F.transform(F.slice(blocks, F.lit(1), i), lambda b, j: F.concat(F.get(parts, j), b)), ""), F.get(parts, i))
        table_id = F.concat(F.lit("table_"), (i + 1).cast("string"))
        return F.struct(F.lit("markdown").alias("source"), table_id.alias("table_id"), grid.alias("grid"), F.lit(1).alias("header_rows"), F.lit(2).alias("skip"), before.alias("before"))

    return once(both, lambda x: F.transform(x["blocks"], lambda block, i: table(block, i, x["blocks"], x["parts"])))


def html_grid(html: Column) -> Column:
    """The rows of HTML table snippets as one table; rows with header cells, else a first row without amounts, are its header."""
    entity = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&nbsp;"), F.lit(" ")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    plain = lambda c: F.trim(F.regexp_replace(entity(F.regexp_replace(c, "(?s)<[^>]*>", "")), r"\s+", " "))

    def row(tr: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>.*?</t[dh]\s*>"), F.lit(0)), plain)
        return F.struct(cells.alias("cells"), tr.rlike(r"(?i)<th[\s>]").alias("th"))

    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr\s*>"), F.lit(1)), row), lambda r: _nonblank(r["cells"]))
    return once(found, _html_table)


def _html_table(rows: Column) -> Column:
    told = F.array_max(F.transform(rows, lambda r, i: F.when(r["th"], i + 1).otherwise(0)))
    first = F.get(rows, F.lit(0))["cells"]
    inferred = F.when((F.size(rows) > 1) & ~F.exists(first, lambda x: amount(x).isNotNull()), 1).otherwise(0)
    head = F.when(told > 0, told).otherwise(inferred)
    table = F.struct(F.lit("html").alias("source"), F.lit("html_1").alias("table_id"), F.transform(rows, lambda r: r["cells"]).alias("grid"), head.cast("int").alias("header_rows"), head.cast("int").alias("skip"), F.lit(None).cast("string").alias("before"))
    return F.when(F.size(rows) > 0, F.array(table)).otherwise(F.array().cast(_GRIDS))


_GRIDS = "array<struct<source:string,table_id:string,grid:array<array<string>>,header_rows:int,skip:int,before:string>>"


def span_grid(json: Column) -> Column:
    """A table given as cells with spans: each place takes the first cell with text that covers it."""
    return once(F.from_json(json, GRID), _span_table)


def _span_table(data: Column) -> Column:
    cells, rows, cols = data["table_cells"], data["num_rows"], data["num_cols"]

    def at(r: Column, c: Column) -> Column:
        row_end = lambda x: F.coalesce(x["end_row_offset_idx"], x["start_row_offset_idx"] + 1)
        col_end = lambda x: F.coalesce(x["end_col_offset_idx"], x["start_col_offset_idx"] + 1)
        covers = lambda x: (r >= x["start_row_offset_idx"]) & (r < row_end(x)) & (c >= x["start_col_offset_idx"]) & (c < col_end(x)) & (F.trim(x["text"]) != "")
        return F.coalesce(F.trim(F.get(F.filter(cells, covers), F.lit(0))["text"]), F.lit(""))

    grid = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: at(r, c)))
    columns = F.array_max(F.transform(cells, lambda x: F.when(x["column_header"], F.coalesce(x["end_row_offset_idx"], x["start_row_offset_idx"] + 1)).otherwise(0)))
    stub = F.array_min(F.transform(F.filter(cells, lambda x: x["row_header"]), lambda x: x["start_row_offset_idx"]))
    head = F.greatest(columns, F.coalesce(stub, F.when(rows > 1, 1).otherwise(0)))
    table = F.struct(F.lit("grid").alias("source"), F.lit("grid_1").alias("table_id"), grid.alias("grid"), head.cast("int").alias("header_rows"), head.cast("int").alias("skip"), F.lit(None).cast("string").alias("before"))
    return F.when((rows > 0) & (cols > 0), F.array(table)).otherwise(F.array().cast(_GRIDS))


def _headers(grid: Column, rows: Column, cols: Column) -> Column:
    """Names of columns from their header cells, repeats told apart."""
    none = F.array().cast("array<string>")

    def name(c: Column) -> Column:
        add = lambda acc, x: F.when((F.coalesce(x, F.lit("")) != "") & ((F.size(acc) == 0) | (F.element_at(acc, -1) != x)), F.concat(acc, F.array(x))).otherwise(acc)
        parts = F.aggregate(F.transform(F.slice(grid, F.lit(1), rows), lambda row: F.trim(F.get(row, c))), none, lambda acc, x: F.coalesce(add(acc, x), acc))
        return once(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, " / ")).otherwise(F.concat(F.lit("column_"), (c + 1).cast("string"))))

    def unique(base: Column, i: Column, bases: Column) -> Column:
        nth = F.size(F.filter(F.slice(bases, F.lit(1), i + 1), lambda x: x == base))
        return F.when(nth == 1, base).when(nth == 2, F.concat(base, F.lit(" / categoria"))).otherwise(F.concat_ws(" / ", base, nth.cast("string")))

    return once(F.transform(F.sequence(F.lit(0), cols - 1), name), lambda bases: F.transform(bases, lambda base, i: unique(base, i, bases)))


def tables(units: DataFrame, about: bool = True, amounts: bool = True) -> DataFrame:
    """One row for each table with a row of data: unit, position, source, table_id, table_type, role, period_from, period_to,
    period_source, headers, lines (array of row_no, cells, amounts). ``units`` has unit, text, html, grid; null columns
    hold no tables. Rows of a unit are handled alone, and its tables are read within one array, so that no step is written
    and none is evaluated again by what filters or columns come after. Who needs neither role nor period (``about``) or no
    amounts gets nulls for them: what lies in an array is read whether a column of it is used or not."""
    found = F.concat(*(F.coalesce(x, F.array().cast(_GRIDS)) for x in (pipe_grids(F.col("text")), html_grid(F.col("html")), span_grid(F.col("grid")))))
    cols = lambda t: F.when(t["source"] == "markdown", F.size(F.get(t["grid"], F.lit(0)))).otherwise(F.array_max(F.transform(t["grid"], F.size)))
    wide = F.filter(F.transform(found, lambda t, i: F.struct(i.alias("position"), cols(t).alias("cols"), t.alias("t"))), lambda x: x["cols"] > 0)
    filled = F.filter(F.transform(wide, lambda x: _rows(x["position"], x["cols"], x["t"], about, amounts)), lambda x: F.size(x["lines"]) > 0)
    read = once(F.array(*statement_period(F.col("text"))), lambda stated: F.transform(filled, lambda x: _table(x, stated))) if about else F.transform(filled, lambda x: _table(x, None))
    return units.select("unit", F.explode(read).alias("t")).select("unit", "t.*")


def _rows(position: Column, cols: Column, t: Column, about: bool, amounts: bool) -> Column:
    """Headers of a grid, and its rows of data, as wide as the table, with their amounts."""
    rows = F.filter(F.slice(t["grid"], t["skip"] + 1, F.greatest(F.size(t["grid"]) - t["skip"], F.lit(0))), _nonblank)
    cells = once(F.sequence(F.lit(0), cols - 1), lambda w: F.transform(rows, lambda row: F.transform(w, lambda c: F.coalesce(F.trim(F.get(row, c)), F.lit("")))))
    line = lambda row, i: F.struct((i + 1).alias("row_no"), row.alias("cells"), (F.transform(row, amount) if amounts else F.lit(None).cast("array<double>")).alias("amounts"))
    last = F.array(*statement_period(t["before"], last=True)) if about else F.lit(None).cast("array<string>")
    return F.struct(position.alias("position"), t["source"].alias("source"), t["table_id"].alias("table_id"), t["before"].alias("before"), _headers(t["grid"], t["header_rows"], cols).alias("headers"), F.transform(cells, line).alias("lines"), last.alias("last"))


def _table(x: Column, stated: Column | None) -> Column:
    same = lambda *names: [x[n].alias(n) for n in names]
    if stated is None:
        nothing = [F.lit(None).cast("string").alias(n) for n in ("role", "period_from", "period_to", "period_source")]
        return F.struct(*same("position", "source", "table_id"), table_type(x["headers"], x["lines"]).alias("table_type"), *nothing, *same("headers", "lines"))
    local = F.coalesce(F.get(x["last"], F.lit(0)), F.get(x["last"], F.lit(1))).isNotNull()
    period = lambda i: F.when(local, F.get(x["last"], F.lit(i))).otherwise(F.get(stated, F.lit(i)))
    source = F.when(local, "preceding_section").otherwise("document_unit")
    role = lambda kind: table_role(kind, x["headers"], F.coalesce(x["before"], F.lit("")))
    told = lambda kind: F.struct(*same("position", "source", "table_id"), kind.alias("table_type"), role(kind).alias("role"), period(0).alias("period_from"), period(1).alias("period_to"), source.alias("period_source"), *same("headers", "lines"))
    return once(table_type(x["headers"], x["lines"]), told)


def table_type(headers: Column, lines: Column) -> Column:
    sample = F.lower(F.array_join(F.flatten(F.transform(F.slice(lines, 1, 5), lambda r: r["cells"])), " "))
    return once(F.struct(F.lower(F.array_join(headers, " ")).alias("head"), sample.alias("sample")), lambda x: _type_of(x["head"], x["sample"], lines))


def _type_of(head: Column, sample: Column, lines: Column) -> Column:
    any_of = lambda text, *words: F.greatest(*(text.contains(w) for w in words), F.lit(False))
    balance = F.exists(lines, lambda r: F.lower(F.array_join(r["cells"], " ")).contains("saldo"))
    flat = any_of(head, "appartamento", "scala", "unita") | any_of(sample, "appartamento", "postoauto") | sample.rlike(r"\b[a-d]\d{1,2}\b")
    return (
        F.when(any_of(head, "rata n.", "totale dovuto"), "payment_schedule")
        .when(head.contains("nominativo") & head.contains("quota mill") & head.contains("totale"), "expense_allocation")
        .when(flat, "expense_allocation")
        .when(any_of(head, "totale gestione", "saldo finale", "importi", "totali"), "summary")
        .when(balance, "balance")
        .otherwise("unknown")
    )


def is_ledger(headers: Column) -> Column:
    low = F.transform(headers, F.lower)
    return F.array_contains(low, "nominativo") & F.array_contains(low, "importo") & F.exists(low, lambda h: h.contains("data pag"))


def table_role(kind: Column, headers: Column, before: Column) -> Column:
    """Of all phrases before the table the one that begins last decides."""
    place = lambda p: F.when(before.rlike("(?is)" + p), F.length(F.regexp_extract(before, "(?is)^(.*)(?:" + p + ")", 1)) + 1).otherwise(0)
    starts = F.filter(F.array(*(F.struct(place(p).alias("at"), F.lit(-i).alias("nth"), F.lit(name).alias("role")) for i, (name, p) in enumerate(ROLES))), lambda x: x["at"] > 0)
    part = lambda said: F.when(said == "budget_summary", "budget_allocation").when(said == "actual_summary", "actual_allocation").otherwise(said)
    told = once(F.array_max(starts)["role"], lambda said: F.when(kind == "expense_allocation", part(said)).otherwise(said))
    return F.when(kind == "payment_schedule", "budget_installment_schedule").when(is_ledger(headers), "actual_payments").otherwise(told)


def _marked(line: Column) -> Column:
    """The first two cells of a line, lower-cased."""
    return F.lower(F.array_join(F.filter(F.slice(line["cells"], 1, 2), lambda x: x != ""), " "))


def totals(found: DataFrame) -> DataFrame:
    """(unit, table_id, table_type, totals): name and amount of each total of a table; of several lines the last stands."""
    marked = F.filter("lines", lambda r: _marked(r).contains("totale") | _marked(r).contains("saldo finale"))

    def entries(r: Column) -> Column:
        known = F.filter(r["amounts"], lambda x: x.isNotNull())
        return once(F.struct(_marked(r).alias("m"), known.alias("known")), lambda x: named(r, x["m"], x["known"]))

    def named(r: Column, m: Column, known: Column) -> Column:
        label = F.when(m.contains("totale gestione"), "Totale gestione").when(m.contains("saldo finale"), "Saldo finale").when(m.contains("totale dovuto"), "Totale dovuto").otherwise("Totale")
        own = F.filter(F.array(F.struct(label.alias("name"), F.element_at(known, -1).alias("amount"))), lambda x: F.size(known) > 0)
        by_column = F.filter(F.zip_with("headers", r["amounts"], lambda h, a: F.struct(h.alias("name"), a.alias("amount"))), lambda x: x["amount"].isNotNull())
        return F.concat(own, by_column)

    last = lambda e: F.transform(F.array_distinct(F.transform(e, lambda x: x["name"])), lambda n: F.struct(n.alias("name"), F.element_at(F.filter(e, lambda x: x["name"] == n), -1)["amount"].alias("amount")))
    return found.select("unit", "position", "table_id", "table_type", "headers", "lines", once(F.flatten(F.transform(marked, entries)), last).alias("totals"))


def _picked(entries: Column, *hints: str) -> Column:
    """The amount of the first name that is, else holds, a hint."""

    def first(hint: str, whole: bool) -> Column:
        low = lambda x: F.lower(F.trim(x["name"]))
        return F.get(F.filter(entries, lambda x: low(x) == hint if whole else low(x).contains(hint)), F.lit(0))["amount"]

    return F.coalesce(*(first(h, True) for h in hints), *(first(h, False) for h in hints))


def checks(found: DataFrame) -> DataFrame:
    """(unit, check_type, status, table_id) of the numeric checks on each unit's tables; units without any get one row
    that says so. Tables give their amounts first, and only these are grouped."""
    df = totals(found)
    summary = F.col("table_type").isin("summary", "balance")
    total, balance, some = _picked(F.col("totals"), "totale gestione"), _picked(F.col("totals"), "saldo finale (euro)", "saldo finale"), _picked(F.col("totals"), "totali", "totale")
    row = F.get(F.filter("lines", lambda r: _marked(r).contains("totale")), F.lit(0))
    amounts = F.filter(F.zip_with("headers", row["amounts"], lambda h, a: F.struct(h.alias("name"), a.alias("amount"))), lambda x: x["amount"].isNotNull())
    rates = F.filter(amounts, lambda x: x["name"].contains("Rata n."))
    rate_sum = F.when(F.size(rates) > 0, F.round(F.aggregate(rates, F.lit(0.0), lambda t, x: t + x["amount"]), 2))
    due = F.when((F.col("table_type") == "payment_schedule") & rate_sum.isNotNull(), _picked(amounts, "totale dovuto"))
    largest = lambda *x: F.array_max(F.transform(F.array_compact(F.array(*x)), F.abs))
    df = df.select("unit", "table_id", "table_type", "totals", F.when(summary, total).alias("total"), F.when(summary, balance).alias("balance"), F.when(summary, largest(total, balance, some)).alias("most"), due.alias("due"), rate_sum.alias("rates"))
    verdict = lambda gap, most: F.when(F.abs(gap) < most, "pass").otherwise("fail")
    one = lambda name, when, status: F.when(when, F.struct(F.lit(name).alias("check_type"), status.alias("status")))
    rows = F.array_compact(
        F.array(
            one("summary_total_matches_balance", F.col("total").isNotNull() & F.col("balance").isNotNull(), verdict(F.col("total") - F.col("balance"), 0.01)),
            one("allocation_totals_extracted", (F.col("table_type") == "expense_allocation") & (F.size("totals") > 0), F.lit("pass")),
            one("installment_sum_matches_total_due", F.col("due").isNotNull(), verdict(F.abs("rates") - F.abs("due"), 0.05)),
        )
    )
    by_table = df.select("unit", "table_id", F.explode(rows).alias("c")).select("unit", "c.check_type", "c.status", "table_id")
    by_unit = df.groupBy("unit").agg(F.max("most").alias("most"), F.max(F.abs("due")).alias("due")).where("most is not null and due is not null")
    by_unit = by_unit.select("unit", F.lit("statement_total_matches_payment_schedule").alias("check_type"), verdict(F.col("most") - F.col("due"), 0.05).alias("status"), F.lit(None).cast("string").alias("table_id"))
    all_rows = by_table.unionByName(by_unit)
    silent = found.select("unit").distinct().join(all_rows, "unit", "left_anti").select("unit", F.lit("no_numeric_validation_available").alias("check_type"), F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("table_id"))
    return all_rows.unionByName(silent)


def sections(found: DataFrame) -> DataFrame:
    """(unit, section, role, table_types, table_ids, table_count, row_count): tables by role, in order of the first of each."""
    default = F.when(F.col("table_type") == "payment_schedule", "budget_installment_schedule").when(F.col("table_type") == "expense_allocation", "allocation").otherwise(F.col("table_type"))
    df = found.withColumn("role", F.coalesce("role", default))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])
    one = df.groupBy("unit", "role").agg(F.min("position").alias("first"), F.array_distinct(in_order("table_type")).alias("table_types"), in_order("table_id").alias("table_ids"), F.count(F.lit(1)).alias("table_count"), F.sum(F.size("lines")).alias("row_count"))
    return one.withColumn("section", F.row_number().over(Window.partitionBy("unit").orderBy("first"))).drop("first")


def _subject(x: Column) -> Column:
    blocked = once(F.lower(x), lambda low: F.greatest(*(low.contains(w) for w in ("fatt.", "rata ", "totale", "saldo", "euro"))))
    return (F.length(x) <= 72) & ~blocked & (F.size(F.regexp_extract_all(x, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ']+"), F.lit(0))) >= 2)


def account_identity(headers: Column, cells: Column) -> Column:
    """(unit_code, subject) of a line: a name with its code, a code before a name, or a cell with each; null without both."""
    return once(F.filter(F.zip_with(headers, cells, lambda h, v: F.struct(h.alias("h"), v.alias("v"))), lambda x: x["v"] != ""), _identity)


def _identity(filled: Column) -> Column:
    code = lambda x: F.replace(F.upper(x), F.lit(" "), F.lit(""))
    pair = lambda c, s: F.struct(code(c).alias("unit_code"), F.trim(F.regexp_replace(s, r"\s+", " ")).alias("subject"))
    after = r"(?i)^\s*(.+?)\s*\(([A-Z]{1,2}\s*\d{1,3})\)\s*$"
    before = r"(?i)^\s*-?\s*([A-Z]{1,2}\s*\d{1,3})\s+([A-ZÀ-ÖØ-Ý' ]{3,60}?)(?:\s+-|$)"
    alone = r"(?i)^\s*([A-Z]{1,2}\s*\d{1,3})(?:\s*\([^)]*\))?\s*$"
    prefixed = lambda v: F.when(v.rlike(before) & _subject(F.trim(F.regexp_extract(v, before, 2))), pair(F.regexp_extract(v, before, 1), F.regexp_extract(v, before, 2)))
    named = lambda v: F.coalesce(F.when(v.rlike(after) & _subject(F.regexp_extract(v, after, 1)), pair(F.regexp_extract(v, after, 2), F.regexp_extract(v, after, 1))), prefixed(v))
    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))
    is_name = lambda x: F.greatest(*(F.lower(x["h"]).contains(w) for w in ("nominativo", "condomino", "proprietario")))
    one = first(F.transform(F.filter(filled, is_name), lambda x: named(x["v"])))
    two = first(F.transform(filled, lambda x: prefixed(x["v"])))
    bare = code(F.regexp_extract(F.get(F.filter(filled, lambda x: x["v"].rlike(alone)), F.lit(0))["v"], alone, 1))
    who = lambda bare: F.get(F.filter(filled, lambda x: _subject(x["v"]) & ~F.lower(x["v"]).contains(F.lower(bare))), F.lit(0))["v"]
    both = lambda bare: once(who(bare), lambda x: F.when(x.isNotNull(), F.struct(bare.alias("unit_code"), x.alias("subject"))))
    three = once(bare, lambda bare: F.when(bare.isNotNull(), both(bare)))
    return F.coalesce(one, two, three)


def fact_column(column: Column, kind: Column, ledger: Column, raw: Column) -> Column:
    """(fact_type, category, is_total) of the amounts under a column; null for columns without meaning and for thousandths."""
    return once(F.lower(column), lambda low: _fact_of(column, low, kind, ledger, raw))


def _fact_of(column: Column, low: Column, kind: Column, ledger: Column, raw: Column) -> Column:
    fact = lambda name, label, total: F.struct(F.lit(name).alias("fact_type"), label.cast("string").alias("category"), F.lit(total).alias("is_total"))
    none = F.lit(None)
    out = F.when(low.rlike(r"^column_\d+$") | (low.contains("mill") & F.translate(raw, "€ ", "").rlike(r",\d{3,}$")), none)
    out = out.when(ledger & (low == "importo"), fact("payment_received", none, False))
    for word, name, total in COLUMNS:
        out = out.when(low.contains(word), fact(name, column if name == "installment_due" else none, total))
    out = out.when(low.contains("totale gestione") | (low == "totale"), fact("allocated_expense", F.lit("Totale gestione"), True))
    out = out.when((kind == "expense_allocation") & (low == "importo"), fact("personal_charge", none, False))
    return out.when(kind == "expense_allocation", fact("allocated_expense", column, False))


def facts(found: DataFrame) -> DataFrame:
    """One row for each amount of an account: unit, table_id, row_no, column, unit_code, subject, fact_type, category,
    is_total, accounting_role, amount, raw_amount, raw_value, period_from, period_to, period_source. Amounts below half a
    cent are left out; all but balances are taken without their sign. Only exploding, no shuffle."""
    ledger = is_ledger(F.col("headers"))
    df = found.where(F.col("table_type").isin("expense_allocation", "payment_schedule") | ledger).withColumn("ledger", ledger)
    # identities and columns are read inside the arrays that are exploded: a filter on a column would evaluate them again
    named = F.transform("lines", lambda r: F.struct(r["row_no"].alias("row_no"), r["cells"].alias("cells"), r["amounts"].alias("amounts"), account_identity(F.col("headers"), r["cells"]).alias("who")))
    df = df.select("*", F.explode(F.filter(named, lambda r: r["who"].isNotNull())).alias("line")).select("*", F.col("line.who").alias("who"))
    cells = F.filter(F.zip_with("headers", F.arrays_zip("line.cells", "line.amounts"), lambda h, x: F.struct(h.alias("column"), x["cells"].alias("raw_value"), x["amounts"].alias("raw_amount"))), lambda x: F.abs(x["raw_amount"]) >= 0.005)
    told = F.transform(cells, lambda x: F.struct(x["column"].alias("column"), x["raw_value"].alias("raw_value"), x["raw_amount"].alias("raw_amount"), fact_column(x["column"], F.col("table_type"), F.col("ledger"), x["raw_value"]).alias("f")))
    df = df.select("unit", "table_id", "table_type", "role", "period_from", "period_to", "period_source", "who", F.col("line.row_no").alias("row_no"), F.explode(F.filter(told, lambda x: x["f"].isNotNull())).alias("x")).select("*", F.col("x.f").alias("f"))
    role = F.coalesce("role", F.when(F.col("f.fact_type") == "personal_charge", "actual_personal_charge"))
    value = F.when(F.col("f.fact_type").isin(SIGNED), F.col("x.raw_amount")).otherwise(F.abs("x.raw_amount"))
    return df.select("unit", "table_id", "row_no", "x.column", "who.unit_code", "who.subject", "f.fact_type", "f.category", "f.is_total", role.alias("accounting_role"), value.alias("amount"), "x.raw_amount", "x.raw_value", "period_from", "period_to", "period_source")


def accounts(rows: DataFrame) -> DataFrame:
    """(unit, account_key, unit_code, subject, aliases, n_facts) of ``facts``: the commonest alias by lines, then the
    longest, then the last in order, names the account."""
    key = ["unit", F.lower("unit_code").alias("account_key")]
    alias = rows.groupBy(*key, "subject").agg(F.count_distinct("table_id", "row_no").alias("n"), F.count(F.lit(1)).alias("facts"), F.min(F.struct("table_id", "row_no", "unit_code"))["unit_code"].alias("unit_code"))
    best = F.max_by("subject", F.struct("n", F.length("subject"), "subject")).alias("subject")
    return alias.groupBy("unit", "account_key").agg(F.min("unit_code").alias("unit_code"), best, F.sort_array(F.collect_set("subject")).alias("aliases"), F.sum("facts").alias("n_facts"))
