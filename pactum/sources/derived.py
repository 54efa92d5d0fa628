"""Contract-like documents derived from the customer table, in SQL that Spark and DuckDB both read.

Each customer gives a contract whose kind, clauses and figures follow from the row's keys and balance, so the rules have
something to find at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clauses, with # a small number and @ an amount of money.
CLAUSES = [
    "시급 @원을 매월 25일에 지급한다.",
    "회사는 월급 $원을 통화로 지급한다.",
    "근로자는 중도 퇴사 시 위약금 @원을 회사에 배상한다.",
    "근로자는 중도 퇴사하더라도 위약금을 물지 아니한다.",
    "직무 교육비는 퇴사할 때 전액 반환하여야 한다.",
    "근로자는 회사의 승인 없이 퇴사할 수 없다.",
    "퇴직 후 # 개월 동안 같은 업종에 취업할 수 없다.",
    "연차 휴가는 회사가 지정하는 시기에 사용한다.",
    "수습 기간은 # 개월로 하며 같은 임금을 준다.",
    "1년 근속한 근로자에게 연차 # 일을 부여한다.",
    "사업장 사정상 연차를 부여하지 않는다.",
    "근로시간은 1일 # 시간으로 정한다.",
    "근로시간은 1주 # 시간을 원칙으로 한다.",
    "연장 근로에 대한 수당은 월급에 들어 있어 별도로 지급하지 아니한다.",
    "회사는 해고하려면 # 일 전에 알려야 한다.",
    "회사는 사정에 따라 언제든지 해고 처분을 할 수 있다.",
    "퇴직한 근로자의 임금은 # 일 이내에 청산한다.",
    "퇴직금은 급여에 포함하여 매월 지급하는 것으로 한다.",
    "여직원은 결혼하면 퇴직하는 것을 원칙으로 한다.",
    "임금에서 상계할 수 있는 것은 가불 금액으로 한다.",
    "작업 특성상 휴게 시간은 따로 부여하지 않는다.",
    "해고는 문자로 통보할 수 있다.",
    "감봉 처분은 임금의 #% 범위에서 한다.",
    "계약기간은 # 년으로 하고 다시 정할 수 있다.",
    "계약을 갱신하더라도 무기계약으로 보지 않으며 전환되지 않는다.",
    "노동청에 신고한 직원은 징계 대상이 된다.",
    "육아휴직은 회사 사정상 허용하지 않는다.",
    "취업규칙은 회사가 일방적으로 바꿀 수 있다.",
    "국적에 따라 임금을 달리 정한다.",
    "상사의 폭언에 대하여 이의를 제기하지 않는다.",
    "출산전후휴가는 # 일을 준다.",
    "배우자가 출산한 때의 휴가는 무급으로 한다.",
    "이직을 방해할 목적의 명단을 만들 수 있다.",
    "휴일은 매주 일요일로 하고 근로자의 날을 포함한다.",
    "근무장소와 담당업무는 따로 정하는 바에 따른다.",
    "근로자는 출퇴근 시각을 지키고 회사의 지휘와 감독을 받는다.",
    "수급인은 용역 산출물을 납품하고 검수를 받아 대금을 받는다.",
    "포괄 연장 수당 외에 추가 지급하지 않는다.",
    "육아휴직 후 복귀를 보장하지 않는다.",
    "취업규칙을 바꿀 때 의견 청취 절차를 생략한다.",
    "고충을 외부에 제기하는 것을 금지한다.",
    "퇴직자 명단을 거래처에 공유할 수 있다.",
    "감봉의 한도는 회사가 정하는 바에 따른다.",
]
TITLES = ["표준근로계약서", "근로계약서", "용역계약서", "수료증", "계약 안내"]
_BANK = "~".join(CLAUSES)
_TITLES = "~".join(TITLES)
PER_CONTRACT = 7


def _clause(k: int) -> str:
    pick = f"split_part('{_BANK}', '~', CAST(1 + (c_custkey * {7 + 2 * k} + {11 * k}) % {len(CLAUSES)} AS INT))"
    small = f"CAST((c_custkey * {13 + k} + {5 * k}) % 60 AS STRING)"
    # amounts from 9,000 on with a comma, and from 400,000 on without
    money = f"CAST(9 + (c_custkey + {k}) % 3 AS STRING) || ',' || lpad(CAST((c_custkey * {37 + k}) % 1000 AS STRING), 3, '0')"
    monthly = f"CAST(400000 + (c_custkey * {7919 + k}) % 2400000 AS STRING)"
    return f"chr(10) || '제{k + 1}조(항목{k + 1}) ' || replace(replace(replace({pick}, '#', {small}), '@', {money}), '$', {monthly})"


#: What the law says of each clause of the bank, by its index: (law, severity, condition on small, money and monthly).
#: Clauses that aren't here are lawful. Found by reading the clauses, not by the rules' patterns.
LABELS = {
    0: ("최저임금법-제6조", "violation", "money < 10320"),
    1: ("최저임금법-제6조", "violation", "monthly < 2156880 AND monthly >= 500000"),
    2: ("근로기준법-제20조", "violation", "true"),
    4: ("근로기준법-제20조", "violation", "true"),
    5: ("근로기준법-제7조", "violation", "true"),
    7: ("근로기준법-제60조", "unfavorable", "true"),
    8: ("최저임금법-제5조", "unfavorable", "small > 3"),
    9: ("근로기준법-제60조", "violation", "small < 15"),
    10: ("근로기준법-제60조", "violation", "true"),
    11: ("근로기준법-제50조", "violation", "small > 8"),
    12: ("근로기준법-제50조", "violation", "small > 40"),
    13: ("근로기준법-제56조", "violation", "true"),
    14: ("근로기준법-제26조", "violation", "small < 30"),
    15: ("근로기준법-제23조", "violation", "true"),
    16: ("근로기준법-제36조", "violation", "small > 14"),
    17: ("근로자퇴직급여보장법-제8조", "violation", "true"),
    18: ("남녀고용평등법-제11조", "violation", "true"),
    19: ("근로기준법-제43조", "unfavorable", "true"),
    20: ("근로기준법-제54조", "violation", "true"),
    21: ("근로기준법-제27조", "violation", "true"),
    22: ("근로기준법-제95조", "violation", "small > 10"),
    23: ("기간제법-제4조", "unfavorable", "small > 2"),
    24: ("기간제법-제4조", "violation", "true"),
    25: ("근로기준법-제104조", "violation", "true"),
    26: ("남녀고용평등법-제19조", "violation", "true"),
    27: ("근로기준법-제94조", "violation", "true"),
    28: ("근로기준법-제6조", "violation", "true"),
    29: ("근로기준법-제76조의2", "violation", "true"),
    30: ("근로기준법-제74조", "violation", "small < 90"),
    31: ("남녀고용평등법-제18조의2", "violation", "true"),
    32: ("근로기준법-제40조", "violation", "true"),
    37: ("근로기준법-제56조", "violation", "true"),
    38: ("남녀고용평등법-제19조", "violation", "true"),
    39: ("근로기준법-제94조", "violation", "true"),
    40: ("근로기준법-제76조의2", "violation", "true"),
    41: ("근로기준법-제40조", "violation", "true"),
    42: ("근로기준법-제95조", "violation", "true"),
}


CONTRACTS_SQL = (
    f"SELECT c_custkey AS doc_id, c_nationkey, split_part('{_TITLES}', '~', CAST(1 + c_custkey % {len(TITLES)} AS INT))"
    + " || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE chr(10) || '사용자와 근로자는 다음과 같이 계약한다.' END"
    + "".join(f" || {_clause(k)}" for k in range(PER_CONTRACT))
    + " || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || '(사업주) 사업체명 : 한빛' || CAST(c_nationkey AS STRING) || '상사 (전화 : 02-123-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ')'"
    + " || chr(10) || '(근로자) 성명 : 김' || CAST(c_custkey AS STRING) || ' (서명)' END AS text FROM customer"
)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, c_nationkey, text), one contract a customer.

    Customers are dealt over tasks by their keys first: a file of a few MB, which Spark reads in a task or two, gives texts of
    fifty times its size. What groups by doc_id later finds the rows in place.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey").repartition(tasks, "c_custkey")
    return spark.sql(CONTRACTS_SQL.replace("FROM customer", "FROM {customer}"), customer=customer)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, clause_seq, law_id, severity) of every clause that breaks or bends a law, by the bank's index and the figures."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, key = F.col("k"), F.col("c_custkey")
    said = customer.select(key, F.explode(F.array(*map(F.lit, range(PER_CONTRACT)))).alias("k")).select(
        key.alias("doc_id"),
        (k + 1).alias("clause_seq"),
        ((key * (7 + 2 * k) + 11 * k) % len(CLAUSES)).alias("clause"),
        ((key * (13 + k) + 5 * k) % 60).alias("small"),
        ((9 + (key + k) % 3) * 1000 + (key * (37 + k)) % 1000).alias("money"),
        (400000 + (key * (7919 + k)) % 2400000).alias("monthly"),
    )
    label = F.coalesce(*(F.when((F.col("clause") == i) & F.expr(test), F.struct(F.lit(law).alias("law_id"), F.lit(severity).alias("severity"))) for i, (law, severity, test) in LABELS.items()))
    return said.withColumn("label", label).where("label is not null").select("doc_id", "clause_seq", "label.law_id", "label.severity")
