"""Views that the given tables stand in for: tool histories, model attempts, run events, calls.

Each view's columns are SQL that both Spark and DuckDB read, so a query and its counterpart start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = "cast(regexp_extract(props, '[0-9]+', 0) as int)"

MESSAGES = f"""select user_id as conv_id, event_id as pos,
  case event_type when 'signup' then 'user' when 'error' then 'system' when 'click' then 'tool' else 'assistant' end as role,
  concat(event_type, ' ', cast(event_id as string)) as content,
  case when event_type = 'view' then concat('call-', cast({_NUMBER} % 12 as string)) end as call_id,
  case when event_type = 'click' then concat('call-', cast({_NUMBER} % 12 as string)) end as tool_call_id,
  case when event_type in ('view', 'click') then concat('tool_', cast({_NUMBER} % 4 as string)) end as tool_name
from events"""

ATTEMPTS = """select l_orderkey as request_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as model_rank,
  case when l_returnflag = 'A' then 200 when l_returnflag = 'N' then 429 when l_discount > 0.05 then 503 else 400 end as status,
  cast(l_quantity as int) * 10 as input_tokens,
  cast(round(l_tax * 100) as int) as output_tokens
from lineitem"""

RUN_EVENTS = f"""select user_id as run_id, event_id as seq, ts,
  case event_type when 'view' then 'model_start' when 'click' then 'model_end' when 'signup' then 'tool_start' when 'purchase' then 'tool_end' else 'output_rejected' end as kind,
  concat('tool_', cast({_NUMBER} % 4 as string)) as tool_name,
  case when event_type = 'click' then cast(floor(value) as int) else 0 end as input_tokens,
  case when event_type = 'click' then {_NUMBER} else 0 end as output_tokens,
  case when event_type = 'purchase' and event_id % 3 <> 0 then concat('bad argument ', cast(event_id % 5 as string)) end as err,
  event_id % 3 = 1 as err_correctable
from events"""

#: Tool calls of one turn a request; a supplier's number gives the tool.
CALLS = """select request_id as run_id, 0 as turn, cast(model_rank - 1 as int) as ord, concat('c', cast(model_rank as string)) as call_id,
  concat('tool_', cast(input_tokens % 7 as string)) as name, concat('{"n":', cast(input_tokens as string), '}') as args
from v_attempts"""

VIEWS = {"v_messages": MESSAGES, "v_attempts": ATTEMPTS, "v_run_events": RUN_EVENTS, "v_calls": CALLS}
_BASE = {"v_messages": "events", "v_attempts": "lineitem", "v_run_events": "events", "v_calls": "lineitem"}


def with_views(*names: str) -> str:
    """The start of a DuckDB query over these views."""
    needed = [v for v in VIEWS if v in names or v == "v_attempts" and "v_calls" in names]
    return "with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in needed)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = _BASE[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "v_calls":
        return spark.sql(CALLS.replace("{", "{{").replace("}", "}}").replace("from v_attempts", "from {v_attempts}"), v_attempts=view(spark, sf_dir, "v_attempts"))
    return spark.sql(VIEWS[name].replace(f"from {table}", "from {source}"), source=df)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_messages in the library's shape: each call as an array of one."""
    df = view(spark, sf_dir, "v_messages")
    call = F.array(F.struct(F.col("call_id").alias("id"), F.col("tool_name").alias("name"), F.lit("{}").alias("args")))
    return df.select("conv_id", "pos", "role", "content", F.when(F.col("call_id").isNotNull(), call).alias("tool_calls"), "tool_call_id", F.when(F.col("role") == "tool", F.col("tool_name")).alias("tool_name"))


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"tool_{i}", "{}", i % 3, i % 3 == 0) for i in range(6)], "name string, schema string, max_retries int, sequential boolean")
