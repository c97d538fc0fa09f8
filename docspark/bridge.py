"""The archive's tables, made from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of lineitem that one task joins into mentions.
LINES = 500_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()

_PARTS = """select c.c_nationkey as context, c.c_custkey as account, 'subject' as role, cast(extract(year from o.o_orderdate) as int) as period,
  p.p_type as category, cast(round(l.l_extendedprice * 100) as bigint) as cents, l.l_orderkey as unit
  from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {customer} c on o.o_custkey = c.c_custkey join {part} p on l.l_partkey = p.p_partkey"""
_TOTALS = "select context, account, role, period, cast(sum(cents) + case account % 5 when 0 then 1 when 1 then 100 else 0 end as bigint) as cents from parts group by context, account, role, period"

VIEWS = {
    # components by category, and reported totals: off by nothing, a cent or a unit; some reported twice
    "facts": f"""with parts as ({_PARTS}), totals as ({_TOTALS})
      select context, account, role, period, category, cents, false as is_total, unit from parts
      union all select context, account, role, period, 'total', cents, true, cast(0 as bigint) from totals where account % 11 <> 0
      union all select context, account, role, period, 'total', cents, true, cast(0 as bigint) from totals where account % 7 = 0""",
    # what the statements of the units marked 2-HIGH are written from
    "charges": """select l_orderkey as unit, l_linenumber as line, cast(round(l_extendedprice * 100) as bigint) as cents, cast(l_quantity * 100 as bigint) as water,
      c_mktsegment as segment, cast(extract(year from o_orderdate) as int) as year
      from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey where o_orderpriority = '2-HIGH'""",
    "units": """select o_orderkey as unit, o_custkey as document, o_orderdate as created,
      case o_orderpriority when '1-URGENT' then 'utility_bill' when '2-HIGH' then 'accounting_statement' when '3-MEDIUM' then 'meeting_minutes' when '4-NOT SPECIFIED' then 'regulation' else 'letter' end as kind,
      case when o_orderkey % 13 = 0 then null else concat('Unit ', cast(o_orderkey as string)) end as title,
      cast(o_orderkey % 100 as int) as seg_conf, cast((o_orderkey * 7) % 100 as int) as class_conf from {orders}""",
    "assignments": """select l_orderkey as unit, l_partkey as topic, case l_returnflag when 'A' then 'subject' when 'N' then 'secondary' else 'document_family' end as role,
      cast(round(l_discount * 100) as int) as confidence, l_shipdate as created, l_linenumber as line from {lineitem}""",
    "mentions": """select l_orderkey as unit, o_custkey as document, 'organization' as kind, s_name as value, l_linenumber as ordinal, cast(round(l_discount * 100) as int) as confidence
      from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey
      union all select l_orderkey, o_custkey, 'place', n_name, l_linenumber, cast(round(l_tax * 100) as int)
      from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey
      union all select l_orderkey, o_custkey, 'address', p_brand, l_linenumber, cast(round(l_discount * 100) as int)
      from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    "topics": """select *, lower(replace(replace(title, ' ', '-'), '#', '-')) as slug from (select p_partkey as topic,
      concat(case p_partkey % 9 when 0 then 'Verbale assemblea ' when 1 then 'Fattura ' when 2 then 'Preventivo ' when 3 then 'Regolamento 2023 ' when 4 then 'Estratto conto ' when 5 then 'Contratto ' when 6 then 'Condominio Via Roma ' when 7 then 'Pagamento rata ' else '' end, p_name, ' ', p_brand) as title,
      concat('pratica ', p_name, case when p_partkey % 4 = 0 then ' quietanza' else '' end) as description, p_type as class,
      case p_type when 'PROMO' then 'meeting' when 'SMALL' then 'vendor_relationship' when 'LARGE' then 'financial_period' when 'MEDIUM' then 'building_issue' when 'ECONOMY' then 'legal_matter' else 'general_administration' end as topic_class,
      case p_type when 'PROMO' then 'family' when 'SMALL' then 'entity' when 'LARGE' then 'project' else 'issue' end as topic_kind, p_partkey % 3 <> 0 as is_active, p_size as weight from {part}) as t""",
    "notes": """select o_orderkey as unit, concat(case o_orderkey % 4 when 0 then 'Verbale ' when 1 then 'Fattura ' when 2 then 'Lettera ' else 'Contratto ' end, p_name) as title,
      case o_orderkey % 3 when 0 then concat('Quietanza pagamento BL', lpad(cast(o_orderkey - 1 as string), 8, '0')) when 1 then concat('Dettaglio consumi Enel Servizio Elettrico ', cast(cast(date_trunc('month', o_orderdate) as date) as string)) else concat('pratica ', p_name) end as summary,
      case o_orderkey % 4 when 0 then 'verbale_assemblea' when 1 then 'fattura' when 2 then 'lettera' else 'contratto' end as document_type, cast(date_trunc('month', o_orderdate) as date) as month, p_brand as brand
      from {orders} join (select l_orderkey, min(l_partkey) as p from {lineitem} group by l_orderkey) as l on o_orderkey = l_orderkey join {part} on p = p_partkey""",
    "bills": """select o_orderkey as unit, case o_orderkey % 3 when 0 then 'Enel Servizio Elettrico S.p.A.' when 1 then 'Acque S.p.A. Toscana' else 'Publiacqua servizi' end as issuer, concat('ROSSI ', c_mktsegment) as holder,
      cast(o_orderdate as date) as issue_date, cast(o_orderdate + interval '20' day as date) as due_date, cast(round(o_totalprice * 100) as bigint) as cents, lpad(cast(o_orderkey as string), 8, '0') as code,
      cast(date_trunc('month', o_orderdate) as date) as period_from, last_day(o_orderdate) as period_to,
      case o_orderkey % 4 when 0 then 'paid' when 1 then 'unpaid' when 2 then 'paid' else 'unknown' end as payment_status from {orders} join {customer} on o_custkey = c_custkey where o_orderpriority = '1-URGENT'""",
    "decisions": """select l_orderkey as unit, l_linenumber as line, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as nth,
      case l_linenumber % 4 when 0 then 'assign_existing' when 1 then 'assign_multiple' when 2 then 'propose_new' else 'none' end as decision,
      case l_partkey % 4 when 0 then cast(l_partkey as string) when 1 then replace(p_name, ' ', '-') when 2 then concat('Fattura ', p_name, ' ', p_brand) else concat('nuova-', replace(p_name, ' ', '-')) end as reference from {lineitem} join {part} on l_partkey = p_partkey""",
    # scans of which some are regulations that were split into units of two pages
    "scan_pages": """select conv_id as scan, cast(turn + 1 as int) as page, case when conv_id % 4 = 0 then 0 when conv_id % 4 = 1 then 90 else cast((conv_id + turn) % 4 * 90 as int) end as rotation,
      case when conv_id % 6 = 5 then ' ' when conv_id % 3 = 0 then concat('Regolamento art. ', cast(turn as varchar(9)), ' ', text) else text end as text from {conversations}""",
    "scan_units": """select scan, scan * 100 + part as unit, cast(part + 1 as int) as ordinal, cast(min(turn) + 1 as int) as start_page, cast(max(turn) + 1 as int) as end_page, case when scan % 4 = 3 then null when part % 4 = 0 then 'regolamento_condominiale' when part % 4 = 1 then 'contratto' when scan % 7 = 6 then 'fattura' else 'lettera' end as kind,
      case when scan % 2 = 0 then concat('Parte ', cast(part as varchar(9))) end as title, case when scan % 3 = 0 then 'Regolamento del condominio, articolo primo' when part = 1 then 'Condominio' else 'Lettera' end as summary
      from (select conv_id as scan, turn, cast(floor(turn / 2) as bigint) as part from {conversations}) as t group by scan, part""",
    # a unit for every page and up to three after it, so that units overlap and some end behind their scan
    "scan_parts": """select conv_id as scan, conv_id * 1000 + turn as unit, cast(turn + 1 as int) as start_page, cast(turn + 1 + (conv_id + turn) % 4 as int) as end_page from {conversations}""",
    # whole texts of scans, two lines a page; some without text or pages
    "scan_results": """select scan, case when scan % 9 = 8 then null when scan % 9 = 7 then '' else {JOINED} end as markdown, cast(case when scan % 11 = 10 then 0 else max(page) end as int) as page_count
      from (select conv_id as scan, turn + 1 as page, concat(role, chr(10), text) as line from {conversations}) as t group by scan""",
    "proposals": """select o_orderkey as proposal, o_orderkey as unit, case when o_orderkey % 3 = 0 then null else p end as topic, concat('Proposta ', p_name) as title,
      case when o_orderkey % 7 = 0 then concat('nuova-', replace(p_name, ' ', '-')) else named end as slug, cast(o_orderkey % 100 as int) as confidence, o_orderdate as created,
      case o_orderkey % 8 when 0 then 'merged_into_existing' when 1 then 'rejected' when 2 then 'approved' else 'proposed' end as status from {orders} join (select l_orderkey, min(l_partkey) as p from {lineitem} group by l_orderkey) as l on o_orderkey = l_orderkey
      join (select p_partkey, p_name, lower(replace(replace(concat(case p_partkey % 9 when 0 then 'Verbale assemblea ' when 1 then 'Fattura ' when 2 then 'Preventivo ' when 3 then 'Regolamento 2023 ' when 4 then 'Estratto conto ' when 5 then 'Contratto ' when 6 then 'Condominio Via Roma ' when 7 then 'Pagamento rata ' else '' end, p_name, ' ', p_brand), ' ', '-'), '#', '-')) as named from {part}) as n on p = p_partkey""",
    "reviews": """select o_orderkey as proposal, case o_orderkey % 4 when 0 then 'merge_into_existing' when 1 then 'approve_new_topic' when 2 then 'add_secondary_topic' else 'reject' end as action,
      case when o_orderkey % 6 = 0 then o_orderkey % 50 when o_orderkey % 5 = 0 then -1 end as target, case when o_orderkey % 4 = 2 then 'secondary' else 'subject' end as role from {orders} where o_orderkey % 10 < 7""",
    "uploads": """select doc_id as upload, case when doc_id % 5 = 0 then null else source end as external_id, {SHA} as sha, n_chars as size_bytes from {documents}""",
    "pages": """select conv_id as scan, cast(turn + 1 as int) as page, concat(case turn % 4 when 0 then concat('# Verbale assemblea', chr(10)) when 1 then 'Fattura Preventivo Contratto ' when 2 then concat('SPESE CONDOMINIO', chr(10)) else '' end, text) as text from {conversations}""",
    "jobs": """select user_id as job, event_id as event, ts, case event_type when 'error' then 'failed' when 'click' then 'running' when 'view' then 'queued' when 'signup' then 'queued' else 'succeeded' end as status from {events}""",
    "detections": """select user_id as document, cast((event_id % 7 % 3) * 90 as int) as rotation, cast(60 + event_id % 40 as int) as confidence from {events}""",
}


def statements(charges: DataFrame) -> DataFrame:
    """(unit, text, html, grid): an allocation and a summary as pipes, a payment schedule as HTML, a summary as cells with
    spans, written the Italian way out of the charges of each unit. Some totals are off; headings differ by unit."""
    money = lambda cents: F.translate(F.format_number((F.col(cents) if isinstance(cents, str) else cents) / 100, 2), ",.", ".,")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    u, year = F.col("unit"), F.col("year")
    named = text("Condomino ", F.initcap("segment"))
    code = text("A", F.col("line"))
    longer = F.when(F.col("line") % 3 == 0, text(named, " Srl")).otherwise(named)
    half = F.expr("(cents + water) div 2")
    row = text("| ", code, " | ", named, " (", code, ") | ", money("cents"), " | ", money("water"), " | 0,0", F.col("line"), "5 | ", money(F.col("cents") + F.col("water")), " |\n")
    tr = text("<tr><td>", longer, " (", code, ")</td><td>", money(half), "</td><td>", money(F.col("cents") + F.col("water") - half), "</td><td>", money(F.col("cents") + F.col("water")), "</td></tr>")
    ordered = lambda c: F.array_join(F.sort_array(F.collect_list(F.struct("line", c.alias("x"))))["x"], "")
    df = charges.groupBy("unit", "year").agg(ordered(row).alias("rows"), ordered(tr).alias("trs"), F.sum("cents").alias("cents"), F.sum("water").alias("water"), F.sum(half).alias("half"))
    total = F.col("cents") + F.col("water")
    title = F.element_at(F.array(*map(F.lit, ("Rendiconto", "Bilancio preventivo", "Estratto contabile", "Prospetto"))), F.expr("cast(unit % 8 div 2 as int) + 1"))
    heading = F.when(u % 2 == 0, "Consuntivo ripartizioni").otherwise("Spese per palazzina")
    second = F.when(u % 3 == 0, "Situazione della cassa").otherwise("Preventivo di gestione")
    pipes = text(title, " ", year, "\nPeriodo: 01/07/", year - 1, " - 30/06/", year, "\n\n", heading, "\n\n| Unita | Nominativo | Spese generali | Acqua | Quota mill. | Totale gestione |\n|---|---|---|---|---|---|\n", F.col("rows"))
    pipes = text(pipes, "| Totale | | ", money("cents"), " | ", money("water"), " | | ", money(total), " |\n\n", second, "\nPeriodo: 1/7/", year, " - 30/6/", year + 1, "\n\n| Voce | Importi |\n|---|---|\n| Totale gestione | ", money(F.expr("(cents + water) div 2")), " |\n| Saldo finale | ", money(F.expr("(cents + water) div 2")), " |\n")
    due = total + F.when(u % 5 == 0, 100).otherwise(0)
    html = text("<table class='t'><tr><th>Nominativo</th><th>Rata n. 1</th><th>Rata n. 2</th><th>Totale dovuto</th></tr>", F.col("trs"), "<tr><td>Totale</td><td>", money("half"), "</td><td>", money(total - F.col("half")), "</td><td>", money(due), "</td></tr></table>")
    cell = lambda r, c, value, **more: F.struct(F.lit(r).alias("start_row_offset_idx"), F.lit(r + 1).alias("end_row_offset_idx"), F.lit(c).alias("start_col_offset_idx"), F.lit(c + 1).alias("end_col_offset_idx"), (F.lit(value) if isinstance(value, str) else value).alias("text"), F.lit(more.get("head", False)).alias("column_header"), F.lit(False).alias("row_header"))
    cells = [cell(0, 0, "Voce", head=True), cell(0, 1, "Importi", head=True), cell(1, 0, "Totale gestione"), cell(1, 1, money(total)), cell(2, 0, "Saldo finale"), cell(2, 1, money(total + F.when(u % 7 == 0, 100).otherwise(0)))]
    grid = F.to_json(F.struct(F.lit(3).alias("num_rows"), F.lit(2).alias("num_cols"), F.array(*cells).alias("table_cells")))
    return df.select("unit", pipes.alias("text"), html.alias("html"), grid.alias("grid"))


def bill_texts(bills: DataFrame) -> DataFrame:
    """(unit, text) of each bill as printed; every second one names its due day in words."""
    from docspark.operators.bills import MONTHS

    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("due_date"))
    due = F.when(F.col("unit") % 2 == 0, text("Scadenza\n", day("due_date"))).otherwise(text("Entro il ", F.dayofmonth("due_date").cast("string"), " ", month, " ", F.year("due_date").cast("string")))
    said = F.when(F.col("payment_status") == "paid", "I pagamenti delle bollette precedenti risultano regolari.").when(F.col("payment_status") == "unpaid", "La bolletta precedente risulta insoluta.").otherwise("")
    service = F.when(F.col("issuer").startswith("Enel"), "Fornitura di energia elettrica").otherwise("Servizio idrico")
    money = F.translate(F.format_number(F.col("cents") / 100, 2), ",.", ".,")
    out = text(F.col("issuer"), "\nContratto intestato a\n", F.col("holder"), "\nLa mia fornitura\nVIA ROMA 12, SCANDICCI\n", service, "\nData di emissione: ", day("issue_date"), "\n", due, "\nRif. bolletta: BL", F.col("code"), "\nNumero contratto: C", F.col("code"))
    out = text(out, "\nPOD: IT", F.col("code"), "\nPeriodo di riferimento da ", day("period_from"), " al ", day("period_to"), "\nTotale bolletta:\n", money, "\n", said, "\n")
    return bills.select("unit", out.alias("text"))


def view(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    """A table of the archive; as a stream, if its SQL needs no join or order."""
    if name == "statements":
        return statements(view(spark, sf_dir, "charges"))
    sql = VIEWS[name]
    path = lambda t: f"{sf_dir}/{t}.parquet"  # noqa: E731  # a stream takes a single file by a pattern only
    read = lambda t: spark.readStream.schema(spark.read.parquet(path(t)).schema).parquet(path(t)[:-1] + "[t]") if stream else spark.read.parquet(path(t))
    used = {t: read(t) for t in TABLES if "{" + t + "}" in sql}
    if name == "mentions" and not stream:
        parts = -(-used["lineitem"].count() // LINES)
        if parts > 4:  # small tables are joined as Spark sees fit; larger ones in tasks whose memory doesn't grow with them
            used |= {t: used[t].repartition(parts, key) for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    sql = sql.replace("{SHA}", "sha2(text, 256)").replace("{JOINED}", "array_join(transform(array_sort(collect_list(struct(page, line))), x -> x.line), chr(10))")
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, with the views it names as common table expressions."""
    import re

    made = []
    for name, text in VIEWS.items():
        if re.search(rf"\bv_{name}\b", sql):
            text = text.replace("{SHA}", "sha256(text)").replace("{JOINED}", "string_agg(line, chr(10) order by page, line)").replace("cast(o_orderkey as string)", "cast(o_orderkey as varchar)")
            made.append(f"v_{name} as ({re.sub(r'{(\w+)}', r'\1', text)})")
    sql, word = sql.strip(), "with "
    if not made:
        return sql
    if sql.lower().startswith("with recursive "):
        sql, word = "with " + sql[len("with recursive ") :], "with recursive "
    return word + ", ".join(made) + (", " + sql[5:] if sql.lower().startswith("with ") else " " + sql)
