"""Relations of a model and its reports, derived from the test tables.

There are no model archives among them, so each relation is a query over the tables that Spark and
another SQL engine both run; what the operators make of it is then compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: A name for each part's table: some are system tables, some helpers.
TABLE_NAME = """CASE WHEN p_brand LIKE '%5' THEN 'LocalDateTable_' || p_brand WHEN p_brand LIKE '%4' THEN '_Helper' || p_brand ELSE p_brand END"""

#: A measure for each part, which refers to two others and to its column; some to what is missing.
MODEL_MEASURES = """
    SELECT p_brand AS project_id, p_partkey AS ord, 'T' || CAST(p_size AS VARCHAR(9)) AS table_name, 'M' || CAST(p_partkey AS VARCHAR(19)) AS measure_name, p_partkey,
           CASE WHEN p_partkey = 0 THEN 'SUM(' || 'T' || CAST(p_size AS VARCHAR(9)) || '[C0])'
                ELSE '[M' || CAST(floor(p_partkey / 50) AS VARCHAR(19)) || '] + 1' END AS dax_expression
    FROM part"""

#: The graph of part keys: each leads to its half and its third.
EDGES = """
    SELECT DISTINCT src, dst, label, n FROM (
        SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst, 0 AS n, 'M' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS VARCHAR(19)) AS label FROM part WHERE p_partkey >= 2
        UNION ALL
        SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst, 1 AS n, 'M' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS VARCHAR(19)) AS label FROM part WHERE p_partkey >= 3 AND floor(p_partkey / 3) <> floor(p_partkey / 2)
    ) AS e"""

#: Direct uses: large returned lines; the order is the visual, its priority the page.
USAGE = """
    SELECT l_orderkey AS visual_id, o_orderpriority AS page_name, l_partkey, l_linenumber AS line
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45"""

#: An expression for each part, of one of 18 forms.
EXPRESSIONS = r"""
    SELECT p_partkey, p_brand AS project_id, 'M' || CAST(p_partkey AS VARCHAR(19)) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Measure' ELSE 'Calculated Column' END AS kind,
      CASE p_partkey % 18
        WHEN 0 THEN 'SUM(Sales[C' || k || '])'
        WHEN 1 THEN 'SUM(Sales[Profit]) / SUM(Sales[C' || k || '])'
        WHEN 2 THEN 'CALCULATE(SUM(Sales[C' || k || ']))'
        WHEN 3 THEN 'CALCULATE([Total], FILTER(Sales, Sales[C' || k || '] > ' || k || '))'
        WHEN 4 THEN 'SUMX(Sales, Sales[Quantity] * Sales[C' || k || '])'
        WHEN 5 THEN 'IF([A] > 1, IF([B] > 2, IF([C] > 3, IF([D] > ' || k || ', 1, 2), 3), 4), 5)'
        WHEN 6 THEN 'DIVIDE([M' || k || '] - [LY], [LY], 0)'
        WHEN 7 THEN 'VAR x = [M' || k || '] VAR y = [M' || k || '] RETURN x * y'
        WHEN 8 THEN '/* note [Fake] */ SUM(Sales[C' || k || ']) // rest [Other]'
        WHEN 9 THEN 'IF([M' || k || '] = "a [Fake] (b", "x""y", "z") -- tail / end'
        WHEN 10 THEN 'CALCULATE([M' || k || '], ALL(Sales[Amount]), ALL(''Big Table''))'
        WHEN 11 THEN 'CALCULATE([M' || k || '], USERELATIONSHIP(Sales[Ship], Dates[Date]))'
        WHEN 12 THEN 'CALCULATE(CALCULATE([M' || k || '], REMOVEFILTERS(Sales)), TREATAS(VALUES(Dates[Date]), Sales[Ship]))'
        WHEN 13 THEN 'COUNTROWS(FILTER(''Big Table'', ''Big Table''[C' || k || '] = 5)) / DIVIDE([M1], 2)'
        WHEN 14 THEN '  RANKX(ALL(Sales), [M' || k || '] + [M' || k || '] + [N] + [N])  '
        WHEN 15 THEN 'SUM(Sales[A])' || chr(10) || '+ SUM(Sales[B])' || chr(10) || chr(10) || '+ SUM(Sales[C])' || chr(10) || '+ SUM(Sales[D])' || chr(10) || '+ SUM(Sales[E])' || chr(10) || '+ SUM(Sales[F])' || chr(10) || '+ SUM(Sales[G])' || chr(10) || '+ SUM(Sales[H])' || chr(10) || '+ SUM(Sales[I])' || chr(10) || '+ ' || k || chr(10) || '+ 1'
        WHEN 16 THEN 'a */ b * ' || k
        ELSE 'RETURN [M' || k || ']' END AS dax
    FROM (SELECT *, CAST(p_partkey AS VARCHAR(19)) AS k FROM part) AS p"""

#: A query text for each supplier, one of 23 forms.
QUERIES = r"""
    SELECT s_suppkey, CASE WHEN s_suppkey % 23 = 15 THEN 'calculated' ELSE 'm' END AS type,
      CASE s_suppkey % 23
        WHEN 0 THEN 'let Source = Sql.Database("srv' || k || '", "db") in Source'
        WHEN 1 THEN 'let Source = sql.databases("srv' || k || '") in Source'
        WHEN 2 THEN 'Excel.Workbook(File.Contents("C:/f' || k || '.xlsx"), null, true)'
        WHEN 3 THEN 'Excel.Workbook(Web.Contents("http://h/' || k || '"))'
        WHEN 4 THEN 'SharePoint.Files("https://s/' || k || '", [ApiVersion = 15])'
        WHEN 5 THEN 'Csv.Document(File.Contents("f' || k || '.csv"), [Delimiter=","])'
        WHEN 6 THEN 'Csv.Document(Source{[Name="' || k || '"]}[Content])'
        WHEN 7 THEN 'Web.Contents("https://api/' || k || '", [Headers=[api_key = "abc' || k || '"]])'
        WHEN 8 THEN 'PowerPlatform.Dataflows(null){' || k || '}'
        WHEN 9 THEN 'PostgreSQL.Database("pg' || k || '" , "db' || k || '", [Password="p"])'
        WHEN 10 THEN 'Snowflake.Databases("sf' || k || '", "wh")'
        WHEN 11 THEN 'OData.Feed("https://o/' || k || '")'
        WHEN 12 THEN '#table({"a"}, {{' || k || '}})'
        WHEN 13 THEN 'let x = ' || k || ' in x'
        WHEN 14 THEN 'connect pwd = ''s' || k || ''' SECRET   =  "t' || k || '"'
        WHEN 15 THEN 'FILTER(ALL(T), T[c] > ' || k || ')'
        WHEN 16 THEN 'Oracle.Database("ora' || k || '", [HierarchicalNavigation=true])'
        WHEN 17 THEN 'My_SQL and mysql.Database  ("my' || k || '","db") '
        WHEN 18 THEN 'AzureStorage.' || CASE s_suppkey % 3 WHEN 0 THEN 'Blobs' WHEN 1 THEN 'DataLake' ELSE 'tables' END || '("https://acc' || k || '")'
        WHEN 19 THEN 'Folder.Files("C:/in/' || k || '")'
        WHEN 20 THEN 'Salesforce.' || CASE s_suppkey % 2 WHEN 0 THEN 'Data' ELSE 'Reports' END || '()'
        WHEN 21 THEN CASE s_suppkey % 2 WHEN 0 THEN 'SapHana.Database' ELSE 'SapBusinessWarehouse.Cubes' END || '("sap' || k || '", "00")'
        ELSE 'AnalysisServices.Database("as' || k || '"' || CASE s_suppkey % 2 WHEN 0 THEN ', "cube"' ELSE '' END || ')' END AS expression
    FROM (SELECT *, CAST(s_suppkey AS VARCHAR(19)) AS k FROM supplier) AS s"""

#: A relationship for each customer, with raw spellings of all kinds.
RELATIONSHIPS = """
    SELECT 'n' || CAST(c_nationkey AS VARCHAR(9)) AS project_id, c_custkey AS ord,
      CASE WHEN c_custkey % 29 = 0 THEN 'LocalDateTable_1' WHEN c_custkey % 31 = 0 THEN '' ELSE 'From' || CAST(c_custkey % 7 AS VARCHAR(9)) END AS from_table,
      'FC' || CAST(c_custkey % 11 AS VARCHAR(9)) AS from_column,
      CASE WHEN c_custkey % 31 = 0 AND c_custkey % 2 = 0 THEN '' ELSE 'To' || CAST(c_custkey % 5 AS VARCHAR(9)) END AS to_table,
      'TC' || CAST(c_custkey % 13 AS VARCHAR(9)) AS to_column,
      CASE c_custkey % 12 WHEN 0 THEN 'manyToOne' WHEN 1 THEN '*:1' WHEN 2 THEN 'oneToMany' WHEN 3 THEN ' One_To_One ' WHEN 4 THEN 'many-to-many'
                          WHEN 5 THEN 'many' WHEN 6 THEN 'one' WHEN 7 THEN 'odd' WHEN 8 THEN '' END AS cardinality,
      CASE c_custkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'many' END AS from_cardinality,
      CASE c_custkey % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'Many' WHEN 2 THEN 'none' WHEN 3 THEN 'odd' END AS to_cardinality,
      CASE c_custkey % 8 WHEN 0 THEN 'oneDirection' WHEN 1 THEN 'bothDirections' WHEN 2 THEN 'Both ' WHEN 3 THEN 'automatic' WHEN 4 THEN '' WHEN 5 THEN 'odd' END AS direction,
      CASE c_custkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'No' WHEN 3 THEN '0' WHEN 4 THEN 'odd' END AS is_active
    FROM customer"""

#: A visual for each event, as the fields that its JSON is made of.
VISUALS = """
    SELECT event_id, user_id % 50 AS page, user_id % 7 AS project,
      CASE event_id % 8 WHEN 0 THEN 'card' WHEN 1 THEN 'clusteredColumnChart' WHEN 2 THEN 'tableEx' WHEN 3 THEN 'some3dNewType' WHEN 4 THEN ' LineChart ' WHEN 5 THEN '' WHEN 6 THEN 'Unknown' ELSE 'my_visual' END AS raw_type,
      CASE event_id % 7 WHEN 0 THEN '''Sales by Year''' WHEN 1 THEN 'None' WHEN 2 THEN '"''Inner''"' WHEN 3 THEN 'About [M' || CAST(event_id % 40 AS VARCHAR(9)) || '] now' END AS title,
      CASE event_id % 9 WHEN 0 THEN 'Named ' || CAST(event_id AS VARCHAR(19)) WHEN 1 THEN 'deadBEEF01' END AS display_name,
      'T' || CAST(event_id % 12 AS VARCHAR(9)) AS table_name, 'M' || CAST(event_id % 40 AS VARCHAR(9)) AS field, event_id % 4 AS form
    FROM events"""


def load(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding as a DataFrame; the tables it names are read from the folder."""
    used = [t for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **load(spark, sf_dir, used))


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw nested tables: one for each brand, with a column and, for every third, a measure for each part."""
    part = load(spark, sf_dir, ["part"])["part"].withColumn("name", F.expr(TABLE_NAME))
    digit = "CAST(substring(p_brand, 7) AS INT) % 10"
    column = f"""named_struct('ord', CAST(p_partkey AS INT), 'name', CASE WHEN p_partkey % 97 = 0 THEN '' ELSE 'C' || p_partkey END,
        'dataType', CASE p_size % 4 WHEN 0 THEN 'int64' WHEN 1 THEN 'string' WHEN 2 THEN 'dateTime' END, 'isHidden', CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END,
        'isKey', p_partkey % 50 = 2, 'type', CASE p_partkey % 13 WHEN 0 THEN 'calculated' WHEN 1 THEN 'data' END,
        'expression', CASE p_partkey % 7 WHEN 0 THEN '  SUM(T[C' || p_partkey || ']) ' WHEN 1 THEN 'Variation x' WHEN 2 THEN '' END,
        'formatString', CASE WHEN p_partkey % 3 = 0 THEN '0.0' ELSE '' END, 'description', CASE WHEN p_partkey % 4 = 0 THEN p_type END, 'sourceColumn', p_name,
        'dataCategory', CASE WHEN p_partkey % 50 = 2 AND p_size % 2 = 0 THEN 'Time' END, 'summarizeBy', 'none', 'hasDateVariation', p_partkey % 17 = 0, 'defaultHierarchy', '', 'annotations', array())"""
    measure = """CASE WHEN p_partkey % 3 = 0 THEN named_struct('ord', CAST(p_partkey AS INT), 'name', 'M' || p_partkey, 'expression', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' [M' || p_partkey || '] ' END,
        'formatString', CASE WHEN p_partkey % 2 = 0 THEN '0%' ELSE '' END, 'description', '', 'isHidden', p_size % 2 = 0, 'lineageTag', '') END"""
    grouped = part.groupBy("p_brand", "name").agg(F.expr(f"array_sort(collect_list({column}))").alias("columns"), F.expr(f"array_sort(collect_list({measure}))").alias("measures"))
    out = grouped.selectExpr(
        "'p' AS project_id", "CAST(substring(p_brand, 7) AS INT) AS ord", "name", f"CASE {digit} WHEN 1 THEN true WHEN 2 THEN false END AS isHidden",
        "CASE WHEN p_brand LIKE '%1_' THEN 'About ' || p_brand ELSE '' END AS description", f"CASE WHEN {digit} = 3 THEN 'Time' END AS dataCategory", f"{digit} = 2 AS markAsDateTable",
        f"CASE WHEN {digit} = 1 THEN array(named_struct('name', 'isDateTable', 'value', 'True')) ELSE array() END AS annotations", "columns", "measures", "array() AS partitions",
    )
    return out.to(spark.createDataFrame([], schemas.RAW_TABLE).schema)
