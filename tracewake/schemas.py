"""Data model: table schemas, enumerations, validation and DDL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the enumerations of the data model
INPUT_TYPES = ("diff", "description", "combined")
STATUSES = ("pending", "running", "completed", "failed")
FEEDBACK_TYPES = ("false_positive", "false_negative", "correct")
NODE_TYPES = ("entry", "middle", "leaf")
PROTOCOLS = ("HTTP", "gRPC", "MQ", "Cron", "CLI")
ROLES = ("entry", "library", "service")

CALL_NODE = "struct<func_name:string,file_path:string,line:int,repo:string,node_type:string>"
CALL_CHAIN = f"struct<nodes:array<{CALL_NODE}>,edges:array<struct<`from`:{CALL_NODE},`to`:{CALL_NODE}>>,direction:string>"
ENTRY_POINT = f"struct<node:{CALL_NODE},protocol:string,path:string,test_scenarios:array<string>>"
IMPACT = "struct<direct_functions:array<string>,cross_repo_impact:array<string>,direct_count:int,cross_repo_count:int>"
SCENARIO = "struct<entry_protocol:string,entry_path:string,description:string>"
ANALYSIS_RESULT = f"struct<task_id:string,input_type:string,downward_chain:{CALL_CHAIN},upward_chains:array<{CALL_CHAIN}>,entry_points:array<{ENTRY_POINT}>,impact_summary:{IMPACT},test_scenarios:array<{SCENARIO}>,self_check_report:string>"
MESSAGE = "conv_id string, pos long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"

TABLES = {
    "analysis_tasks": "id string NOT NULL, input_type string NOT NULL, input_diff string, input_desc string, cache_key string, status string NOT NULL, created_at timestamp NOT NULL, completed_at timestamp",
    "analysis_results": f"id string NOT NULL, task_id string, call_chain array<{CALL_NODE}>, test_scenarios string, entry_points array<{ENTRY_POINT}>, token_usage int, step_count int, created_at timestamp",
    "knowledge_base": "id string NOT NULL, repo_name string, symbol string, file_path string, line_number int, summary string, commit_hash string, created_at timestamp, unreliable boolean",
    "feedback": "id string NOT NULL, task_id string, type string, comment string, created_at timestamp",
    "metrics_daily": "date date NOT NULL, total_tasks int, avg_steps decimal(10,2), avg_tokens decimal(10,2), cache_hit_rate decimal(5,4)",
}
#: column: longest value
LENGTHS = {"input_type": 20, "cache_key": 64, "status": 20, "repo_name": 255, "symbol": 512, "commit_hash": 40, "type": 30}


def create_tables(spark: SparkSession, location: str | None = None) -> None:
    """Creates every table that is missing."""
    for name, columns in TABLES.items():
        where = f" LOCATION '{location}/{name}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{where}")


def drop_tables(spark: SparkSession) -> None:
    for name in reversed(TABLES):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def in_enum(c: Column, values: tuple[str, ...]) -> Column:
    """True only for a listed value; null is not listed."""
    return F.coalesce(c.isin(*values), F.lit(False))


def violations(df: DataFrame, enums: dict[str, tuple[str, ...]], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows with an array of the columns that break an enumeration, a length or a NOT NULL."""
    checks = [F.when(~in_enum(F.col(c), v), F.lit(c)) for c, v in enums.items()]
    checks += [F.when(F.col(c).isNull(), F.lit(c)) for c in required if c not in enums]
    checks += [F.when(F.length(c) > n, F.lit(c)) for c, n in LENGTHS.items() if c in df.columns and c not in enums]
    return df.withColumn("violations", F.array_compact(F.array(*checks))).where(F.size("violations") > 0)
