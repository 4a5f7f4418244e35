"""Model responses and tool calls as tables.

Raw response JSON is parsed with declared schemas (``from_json``), tool
calls are exploded into rows and routed against the three chart tools with
their defaults. A malformed argument string is detected with
``try_parse_json`` (plain ``from_json`` would return a struct of nulls).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAT_SCHEMA = (
    "choices array<struct<message: struct<content: string, "
    "tool_calls: array<struct<id: string, function: struct<name: string, arguments: string>>>>>>, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint>")

NATIVE_SCHEMA = (
    "candidates array<struct<content: struct<parts: array<struct<text: string, "
    "functionCall: struct<name: string, args: string>>>>>>, "
    "usageMetadata struct<promptTokenCount: bigint, candidatesTokenCount: bigint>")

CALL_TYPE = "array<struct<id:string,name:string,arguments:string,valid:boolean>>"

# --- FIXED VALUES: tool dimension (name, chart type, defaults) --------------
TOOLS = {
    "plot_monthly_spending_trend": {"chart_type": "monthly_spending_trend",
                                    "defaults": {"months": 1, "category_filter": None}},
    "plot_category_breakdown": {"chart_type": "category_breakdown",
                                "defaults": {"period": "last_3_months", "top_n": 7}},
    "plot_income_vs_expense": {"chart_type": "income_vs_expense",
                               "defaults": {"months": 6, "show_net_line": True}},
}


def _valid_json(s: Column) -> Column:
    return F.try_parse_json(s).isNotNull()


def parse_chat(raw: Column) -> Column:
    """L1: chat-completions JSON -> struct<text, calls, n_malformed, usage>."""
    r = F.from_json(raw, CHAT_SCHEMA)
    msg = F.try_element_at(r["choices"], F.lit(1))["message"]
    calls = F.coalesce(msg["tool_calls"], F.array())
    typed = F.transform(calls, lambda c: F.struct(
        F.coalesce(c["id"], F.lit("")).alias("id"),
        F.coalesce(c["function"]["name"], F.lit("")).alias("name"),
        F.coalesce(c["function"]["arguments"], F.lit("{}")).alias("arguments"),
        _valid_json(F.coalesce(c["function"]["arguments"], F.lit("{}"))).alias("valid")))
    return F.struct(
        F.coalesce(msg["content"], F.lit("")).alias("text"),
        typed.cast(CALL_TYPE).alias("calls"),
        r["usage"]["prompt_tokens"].alias("prompt_tokens"),
        r["usage"]["completion_tokens"].alias("completion_tokens"))


def parse_native(raw: Column) -> Column:
    """L2: generateContent JSON; text parts joined by newline, function calls
    get id 'call_<name>'; no candidates -> empty response."""
    r = F.from_json(raw, NATIVE_SCHEMA)
    parts = F.coalesce(F.try_element_at(r["candidates"], F.lit(1))["content"]["parts"], F.array())
    texts = F.filter(parts, lambda p: p["text"].isNotNull())
    fcalls = F.filter(parts, lambda p: p["text"].isNull() & p["functionCall"].isNotNull())
    typed = F.transform(fcalls, lambda p: F.struct(
        F.concat(F.lit("call_"), F.coalesce(p["functionCall"]["name"], F.lit(""))).alias("id"),
        F.coalesce(p["functionCall"]["name"], F.lit("")).alias("name"),
        F.coalesce(p["functionCall"]["args"], F.lit("{}")).alias("arguments"),
        _valid_json(F.coalesce(p["functionCall"]["args"], F.lit("{}"))).alias("valid")))
    return F.struct(
        F.array_join(F.transform(texts, lambda p: p["text"]), "\n").alias("text"),
        typed.cast(CALL_TYPE).alias("calls"),
        r["usageMetadata"]["promptTokenCount"].alias("prompt_tokens"),
        r["usageMetadata"]["candidatesTokenCount"].alias("completion_tokens"))


def parse_responses(df: DataFrame, raw_col: str = "raw_json",
                    provider_col: str = "provider") -> DataFrame:
    """Both formats into one schema: text, tool_calls (valid only),
    n_malformed, has_tool_calls, malformed_retry flag (L5, Q31)."""
    p = F.when(F.col(provider_col) == "chat", parse_chat(F.col(raw_col))) \
        .otherwise(parse_native(F.col(raw_col)))
    out = df.withColumn("_p", F.when(F.col(raw_col).isNotNull(), p))
    calls = F.coalesce(F.col("_p.calls"), F.array().cast(CALL_TYPE))
    good = F.filter(calls, lambda c: c["valid"])
    return (out.withColumn("llm_text", F.col("_p.text"))
               .withColumn("tool_calls", F.transform(good, lambda c: F.struct(
                   c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments"))))
               .withColumn("n_malformed", F.size(F.filter(calls, lambda c: ~c["valid"])).cast("bigint"))
               .withColumn("prompt_tokens", F.col("_p.prompt_tokens"))
               .withColumn("completion_tokens", F.col("_p.completion_tokens"))
               .withColumn("malformed_retry", (F.col("n_malformed") > 0) & (F.size(good) == 0))
               .drop("_p"))


BAD_ARGUMENTS = "Tool execution error: invalid arguments"


def _argument(args: Column, name: str) -> tuple[Column, Column]:
    """(text, JSON type) of an argument of parsed arguments; the type is null if
    it is absent and VOID if it is an explicit null."""
    value = F.try_variant_get(args, f"$.{name}", "variant")
    return F.try_variant_get(args, f"$.{name}", "string"), F.schema_of_variant(value)


def _whole(text: Column, kind: Column) -> Column:
    """A whole number (6 or 6.0) as bigint, else null."""
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double"))
    return F.when(number == F.floor(number), number.cast("bigint"))


def valid_arguments(name: Column, args: Column) -> Column:
    """Would the tool accept these parsed arguments (a VARIANT)? They are an
    object; months and top_n are whole numbers, period a text, category_filter a
    text or null."""
    ok = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))

    def number(key):
        text, kind = _argument(args, key)
        return kind.isNull() | _whole(text, kind).isNotNull()

    period, category = _argument(args, "period")[1], _argument(args, "category_filter")[1]
    return ok & F.coalesce(
        F.when(name == "plot_monthly_spending_trend",
               number("months") & (category.isNull() | category.isin("STRING", "VOID")))
        .when(name == "plot_category_breakdown", number("top_n") & (period.isNull() | (period == "STRING")))
        .when(name == "plot_income_vs_expense", number("months")), F.lit(False))


def route_tool_calls(parsed: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per valid tool call with defaults filled; unknown tools
    and calls with wrong arguments become error rows (never a failed job). The
    tool dimension is a 3-way CASE (no join needed)."""
    tc = (parsed.select(key, F.posexplode("tool_calls").alias("call_pos", "tc"))
          .withColumn("_args", F.try_parse_json("tc.arguments")))      # parsed once a call
    name, args = F.col("tc.name"), F.col("_args")
    ok = valid_arguments(name, args)

    def arg(path):
        return _argument(args, path)[0]

    known_type = F.lit(None).cast("string")
    for tool, spec in TOOLS.items():
        known_type = F.when(name == tool, F.lit(spec["chart_type"])).otherwise(known_type)
    chart_type = F.when(ok, known_type)
    is_trend = ok & (name == "plot_monthly_spending_trend")
    is_cat = ok & (name == "plot_category_breakdown")
    is_inc = ok & (name == "plot_income_vs_expense")
    asked = _whole(*_argument(args, "months"))
    months = (F.when(is_trend, F.coalesce(asked, F.lit(1)))
              .when(is_inc, F.coalesce(asked, F.lit(6))))
    period = F.when(is_cat, F.coalesce(arg("period"), F.lit("last_3_months")))
    top_n = F.when(is_cat, F.coalesce(_whole(*_argument(args, "top_n")), F.lit(7)))
    category = F.when(is_trend, arg("category_filter"))
    net_text, net_kind = _argument(args, "show_net_line")
    net = F.when(is_inc, F.when(net_kind == "VOID", F.lit(False))
                 .otherwise(F.coalesce(net_text.try_cast("boolean"), F.lit(True))))
    description = (
        F.when(is_trend, F.concat(F.lit("Monthly spending trend chart generated for the last "),
                                  months.cast("string"), F.lit(" month(s).")))
        .when(is_cat, F.concat(F.lit("Category breakdown donut chart generated for "),
                               F.replace(period, F.lit("_"), F.lit(" ")), F.lit(".")))
        .when(is_inc, F.concat(F.lit("Income vs expense chart generated for the last "),
                               months.cast("string"), F.lit(" month(s).")))
    )
    return tc.select(
        key, F.col("call_pos").cast("bigint").alias("call_pos"),
        F.col("tc.id").alias("call_id"), name.alias("tool_name"),
        chart_type.alias("chart_type"), chart_type.isNotNull().alias("success"),
        F.when(known_type.isNull(), F.concat(F.lit("Unknown tool: "), name))
        .when(~ok, F.lit(BAD_ARGUMENTS)).alias("error"),
        months.alias("months"), period.alias("period"), top_n.alias("top_n"),
        category.alias("category_filter"), net.alias("show_net_line"),
        description.alias("description"), F.col("tc.arguments").alias("arguments"),
        F.when(known_type.isNotNull() & ok, args).alias("raw_arguments"))
