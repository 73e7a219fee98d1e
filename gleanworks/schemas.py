"""Explicit schemas of every record the engine reads or writes, and the taxonomy dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from . import lexicons as lx


def _s(ddl: str) -> str:
    """Schemas are kept as DDL text: readers and from_json take it as it is, and importing needs no running JVM."""
    return ddl


CONTENT = "array<struct<role: string, content: array<struct<type: string, text: string, path: string>>>>"
SAMPLE = _s(f"id string, image_path string, image_type string, intent string, difficulty int, messages {CONTENT}, "
            "meta map<string,string>, generator string, created_at string")
SFT_ROW = _s("id string, split string, messages array<struct<role: string, content: string>>, images array<string>, "
             "intent string, image_type string, difficulty int")
EVAL_SAMPLE = _s("id string, query string, images array<string>, difficulty string, intent string, image_type string, "
                 "reference string, must_contain array<string>, must_not_contain array<string>, expected_intent string, "
                 "expected_tool string, expected_slots map<string,string>, should_refuse boolean, "
                 "visible_objects array<string>, phantom_objects array<string>, notes string")
CHECK = "struct<passed: boolean, score: double, detail: string>"
EVAL_RECORD = _s("tag string, id string, difficulty string, intent string, image_type string, query string, "
                 "images array<string>, model_answer string, latency_ms double, error string, judge map<string,double>, "
                 f"rule struct<passed: boolean, score: double, checks: map<string, {CHECK}>>")
PAIR = _s("id string, prompt string, chosen string, rejected string, images array<string>, "
          "chosen_images array<string>, rejected_images array<string>, source string, error_type string")
PAIR_INPUT = _s("id string, prompt string, query string, chosen string, rejected string, images array<string>, "
                "image string, source string, error_type string")
PROBE = _s("qid string, image string, question string, ground_truth boolean, probe_type string, target string")
LABEL = _s("id string, kind string, expect string, `group` string")
AGENT_TASK = _s("tid string, query string, images array<string>, intent string, expected_tools array<string>, "
                "forbidden_tools array<string>, expected_slots map<string,string>, verifier string, "
                "verifier_args map<string,string>, max_steps int")
AGENT_RUN = _s("tid string, reply string, tool_calls array<struct<action: string, action_input: map<string,string>, "
               "success: boolean>>, n_steps int, tokens_in bigint, tokens_out bigint, state map<string,string>, "
               "latency_ms double, error string")
TRACE_LINE = _s("type string, session_id string, meta map<string,string>, started_at double, index int, kind string, "
                "name string, ms double, ok boolean, in_tokens bigint, out_tokens bigint, cost double, "
                "detail map<string,string>, n_steps int, total_ms double, total_cost double")
TRAIN_LINE = "step bigint, loss double, eval_loss double, learning_rate double, grad_norm double, epoch double"
TRAIN_STATE = _s(f"log_history array<struct<{TRAIN_LINE.replace(' bigint', ': bigint').replace(' double', ': double')}>>")
WEBHOOK = _s("webhook_id string, topic string, shop string, body binary, signature string, ts timestamp")
SUBSCRIPTION = _s("shop string, plan string, status string, subscription_id string, capped_amount decimal(10,4), "
                  "period_end timestamp")
USAGE = _s("idempotency_key string, shop string, session_id string, amount decimal(10,4), ts timestamp")
PRODUCT = _s("shop string, id string, title string, description string, category string, vendor string, "
             "tags array<string>, image_urls array<string>, variants array<struct<id: string, title: string, "
             "sku: string, price: string, inventory: int, options: map<string,string>>>, updated_at timestamp")
RAW_PRODUCT = _s("id string, title string, description string, productType string, vendor string, tags array<string>, "
                 "updatedAt timestamp, images struct<nodes: array<struct<url: string>>>, "
                 "variants struct<nodes: array<struct<id: string, title: string, sku: string, price: string, "
                 "inventoryQuantity: int, selectedOptions: array<struct<name: string, value: string>>>>>")
RAW_ORDER = _s("id string, name string, createdAt timestamp, displayFinancialStatus string, "
               "displayFulfillmentStatus string, totalPriceSet struct<shopMoney: struct<amount: string, "
               "currencyCode: string>>, customer struct<id: string, email: string>, "
               "lineItems struct<nodes: array<struct<title: string, quantity: int, sku: string, "
               "originalUnitPriceSet: struct<shopMoney: struct<amount: string, currencyCode: string>>>>>, "
               "fulfillments array<struct<trackingInfo: array<struct<number: string, company: string, url: string>>, "
               "status: string, createdAt: timestamp>>")

# Operational tables kept by the shop application.
WAREHOUSE: dict[str, str] = {
    "shops": _s("id int, shop_domain string, access_token string, scope string, plan string, shopify_shop_id string, "
                "currency string, installed_at timestamp, uninstalled_at timestamp, created_at timestamp, "
                "updated_at timestamp"),
    "sessions": _s("id string, shop_id int, customer_id string, source string, user_agent string, "
                   "started_at timestamp, ended_at timestamp, n_messages int, resolved boolean, escalated boolean"),
    "messages": _s("id bigint, session_id string, role string, content string, image_urls array<string>, "
                   "tool_calls string, visual_evidence string, tokens_in int, tokens_out int, latency_ms int, "
                   "model string, created_at timestamp"),
    "usage_records": _s("id bigint, shop_id int, idempotency_key string, session_id string, amount decimal(10,4), "
                        "reported boolean, reported_at timestamp, created_at timestamp"),
    "subscriptions": _s("id bigint, shop_id int, shopify_subscription_id string, plan string, status string, "
                        "trial_ends_at timestamp, current_period_end timestamp, capped_amount decimal(10,2), "
                        "created_at timestamp, updated_at timestamp"),
    "product_index": _s("id bigint, shop_id int, product_id string, title string, category string, image_url string, "
                        "local_image string, attributes string, embedding array<float>, updated_at timestamp"),
    "knowledge_docs": _s("id bigint, shop_id int, doc_id string, title string, content string, source string, "
                         "embedding array<float>, updated_at timestamp"),
    "webhook_events": _s("id bigint, webhook_id string, topic string, shop_domain string, payload string, "
                         "processed boolean, processed_at timestamp, created_at timestamp"),
    "tickets": _s("id bigint, shop_id int, session_id string, reason string, status string, assigned_to string, "
                  "created_at timestamp, resolved_at timestamp"),
    "audit_log": _s("id bigint, shop_id int, actor string, action string, details string, created_at timestamp"),
}


def warehouse_schemas() -> dict[str, T.StructType]:
    return {name: T.StructType.fromDDL(ddl) for name, ddl in WAREHOUSE.items()}


def intents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n) for k, n in lx.INTENTS], "intent string, intent_name string")


def image_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(lx.IMAGE_TYPES), "image_type string, image_type_name string, difficulty int")


def target_cells(spark: SparkSession) -> DataFrame:
    """The 8 x 6 target matrix as rows, zero cells included."""
    rows = [(i, t, int(n)) for i, line in lx.TARGET_MATRIX.items() for t, n in line.items()]
    return spark.createDataFrame(rows, "intent string, image_type string, target int")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in lx.TIERS], "tier string")


def taxonomy_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Dimension tables: at most 48 rows each, so joining them by broadcast is always safe."""
    return {"intents": intents(spark), "image_types": image_types(spark), "targets": target_cells(spark),
            "tiers": tiers(spark)}
