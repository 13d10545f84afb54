"""Clinical notes rendered from orders and customers, by one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _text(noisy: bool) -> str:
    drug = "CASE o_orderkey % 5 WHEN 0 THEN 'Metformin' WHEN 1 THEN 'asp1rin' WHEN 2 THEN 'Metfornin' WHEN 3 THEN 'omeprazole' ELSE 'WARFARlN' END"
    if not noisy:
        drug = "CASE o_orderkey % 5 WHEN 0 THEN 'Metformin' WHEN 1 THEN 'aspirin' WHEN 2 THEN 'Metformin' WHEN 3 THEN 'omeprazole' ELSE 'WARFARIN' END"
    return f"""concat_ws(chr(10),
  concat('Hospital : Unit ', o_orderpriority),
  CASE o_orderkey % 4 WHEN 0 THEN 'Discharge Summary' WHEN 1 THEN 'Laboratory report, reference range below' WHEN 2 THEN 'Progress note' ELSE 'Prescription:' END,
  concat('Patient Name : ', trim(translate(c_name, '#0123456789', ' abcdefghij'))),
  concat('Age : ', cast(20 + c_custkey % 60 AS string)),
  concat('Gender : ', CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'F' END),
  concat('Date : ', CASE WHEN o_orderkey % 3 = 0 THEN '3/14/2026' ELSE cast(cast(o_orderdate AS date) AS string) END),
  concat('BP : ', cast(100 + o_orderkey % 40 AS string), ' / ', cast(60 + o_orderkey % 30 AS string)),
  concat('Temp: ', cast(36 + o_orderkey % 5 AS string), '.', cast(o_orderkey % 10 AS string), ' C'),
  concat('Pulse: ', cast(60 + c_custkey % 50 AS string), ' bpm'),
  concat('Glucose ', cast(4 + o_orderkey % 9 AS string), '.5 mmol/l'),
  concat('Diagnosis: ', CASE o_orderkey % 3 WHEN 0 THEN 'asthma, mild anemia' WHEN 1 THEN 'hypertension and gout' ELSE 'heart failure' END),
  '- osteoporosis',
  'Rx:',
  concat('- ', {drug}, ' ', cast(5 * (1 + o_orderkey % 20) AS string), 'mg twice daily'),
  concat('2. Ibuprofen ', cast(100 + o_orderkey % 300 AS string), ' mg at bedtime'),
  concat('Also on ', CASE o_orderkey % 7 WHEN 0 THEN 'insulin 10 units daily' WHEN 1 THEN 'tramadol' ELSE 'nothing' END, ' for hart failure'),
  'Instructions: return if condition is severe',
  concat('Seek urgent care: ', CASE o_orderkey % 6 WHEN 0 THEN 'abnormal findings' WHEN 1 THEN 'fever' ELSE 'none' END),
  concat('Consultant: Dr. ', CASE o_orderkey % 2 WHEN 0 THEN 'Lee' ELSE 'Adams' END))"""


def rendered(noisy: bool, truth: bool = False) -> str:
    """SELECT doc_id, kind, text; noisy has the misspelt medicine names. truth adds the right text as a column."""
    more = f", {_text(False)} AS truth" if truth else ""
    return f"""
SELECT o_orderkey AS doc_id, o_orderpriority AS kind, {_text(noisy)} AS text{more}
FROM orders JOIN customer ON o_custkey = c_custkey"""


def notes(spark: SparkSession, sf_dir: str, noisy: bool = True, truth: bool = False) -> DataFrame:
    """doc_id, kind, text (and truth) for each order; the views are private to this call."""
    sql = rendered(noisy, truth).replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}")
    # a small table is one file and so one task; its narrow rows are dealt out before they become whole texts
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return spark.sql(sql, orders=orders, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
