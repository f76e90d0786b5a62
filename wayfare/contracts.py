"""Schemas, keys, vocabularies and templates (data only, no logic)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Table contracts
# ---------------------------------------------------------------------------

TICKET_COLUMNS = [
    "departure_city", "arrival_city", "departure_time", "arrival_time",
    "train_number", "seat_type", "total_seats", "remaining_seats", "price",
    "created_at",
]
TICKET_KEY = ["departure_time", "train_number"]

WEATHER_COLUMNS = [
    "city", "fx_date", "sunrise", "sunset", "moonrise", "moonset", "moon_phase",
    "moon_phase_icon", "temp_max", "temp_min", "icon_day", "text_day",
    "icon_night", "text_night", "wind360_day", "wind_dir_day", "wind_scale_day",
    "wind_speed_day", "wind360_night", "wind_dir_night", "wind_scale_night",
    "wind_speed_night", "precip", "uv_index", "humidity", "pressure", "vis",
    "cloud", "update_time",
]
WEATHER_KEY = ["city", "fx_date"]

# Per column: (spark type as SQL text, nullable, max length for strings or None,
# pattern the text must match or None).
TICKET_CONTRACT = {
    "departure_city": ("string", False, 50, None),
    "arrival_city": ("string", False, 50, None),
    "departure_time": ("timestamp_ntz", False, None, None),
    "arrival_time": ("timestamp_ntz", False, None, None),
    "train_number": ("string", False, 20, None),
    "seat_type": ("string", False, 20, None),
    "total_seats": ("int", False, None, None),
    "remaining_seats": ("int", False, None, None),
    "price": ("decimal(10,2)", False, None, None),
    "created_at": ("timestamp", True, None, None),
}

_TIME = r"^\d{2}:\d{2}:\d{2}$"
WEATHER_CONTRACT = {
    "city": ("string", False, 50, None),
    "fx_date": ("date", False, None, None),
    "sunrise": ("string", True, None, _TIME),
    "sunset": ("string", True, None, _TIME),
    "moonrise": ("string", True, None, _TIME),
    "moonset": ("string", True, None, _TIME),
    "moon_phase": ("string", True, 20, None),
    "moon_phase_icon": ("string", True, 10, None),
    "temp_max": ("int", True, None, None),
    "temp_min": ("int", True, None, None),
    "icon_day": ("string", True, 10, None),
    "text_day": ("string", True, 20, None),
    "icon_night": ("string", True, 10, None),
    "text_night": ("string", True, 20, None),
    "wind360_day": ("int", True, None, None),
    "wind_dir_day": ("string", True, 20, None),
    "wind_scale_day": ("string", True, 10, None),
    "wind_speed_day": ("int", True, None, None),
    "wind360_night": ("int", True, None, None),
    "wind_dir_night": ("string", True, 20, None),
    "wind_scale_night": ("string", True, 10, None),
    "wind_speed_night": ("int", True, None, None),
    "precip": ("decimal(5,1)", True, None, None),
    "uv_index": ("int", True, None, None),
    "humidity": ("int", True, None, None),
    "pressure": ("int", True, None, None),
    "vis": ("int", True, None, None),
    "cloud": ("int", True, None, None),
    "update_time": ("timestamp_ntz", True, None, None),
}

TABLES = {
    "train_tickets": {"pattern": "train_tickets_*.csv", "contract": TICKET_CONTRACT,
                      "columns": TICKET_COLUMNS, "key": TICKET_KEY},
    "weather_data": {"pattern": "weather_data_*.csv", "contract": WEATHER_CONTRACT,
                     "columns": WEATHER_COLUMNS, "key": WEATHER_KEY},
}

# Columns returned by the ticket search and the stored weather lookup.
TICKET_SEARCH_COLUMNS = [
    "departure_city", "arrival_city", "departure_time", "arrival_time",
    "train_number", "seat_type", "total_seats", "remaining_seats", "price",
]
WEATHER_LOOKUP_COLUMNS = [
    "city", "fx_date", "temp_max", "temp_min", "text_day", "text_night",
    "wind_dir_day", "wind_scale_day", "wind_speed_day", "precip", "uv_index",
    "humidity", "pressure", "vis", "cloud", "update_time",
]

# Landed live forecast payload: location plus parallel daily arrays.
FORECAST_PAYLOAD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
        T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
        T.StructField("weather_code", T.ArrayType(T.IntegerType())),
        T.StructField("wind_speed_10m_max", T.ArrayType(T.DoubleType())),
        T.StructField("wind_direction_10m_dominant", T.ArrayType(T.DoubleType())),
    ])),
])

EXPECTED = T.StructType([
    T.StructField("intent", T.StringType()),
    T.StructField("required_agents", T.ArrayType(T.StringType())),
    T.StructField("slots", T.MapType(T.StringType(), T.StringType())),
    T.StructField("missing_slots", T.ArrayType(T.StringType())),
    T.StructField("need_clarification", T.BooleanType()),
])
CASE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("expected", EXPECTED),
])

LOG_EVENT = T.StructType([
    T.StructField("time", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("required_agents", T.ArrayType(T.StringType())),
    T.StructField("missing_slots", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# Routing vocabularies, placeholder words, slot names and labels, statuses,
# weather codes, summaries and case templates, in the reference's order.
# ---------------------------------------------------------------------------

SUPPORTED_AGENTS = ["weather_agent", "ticket_agent"]
WEATHER_KEYWORDS = ["天气", "天气预报", "气温", "温度", "降雨", "下雨", "降雪", "湿度", "风力"]
TRAIN_KEYWORDS = ["新干线", "火车票", "车票", "列车", "火车", "高铁", "动车", "铁路", "班次", "车次"]
FLIGHT_KEYWORDS = ["机票", "航班", "飞机"]
ATTRACTION_KEYWORDS = ["景点", "门票", "攻略", "旅游路线", "推荐路线"]
NEGATIVE_WEATHER_PATTERNS = [
    "不要查天气", "不用查天气", "别查天气", "先别查天气", "不查天气", "不要看天气",
    "不用看天气", "别看天气", "先别看天气", "不要天气预报", "不用天气预报", "不要天气",
    "不用天气", "天气我已经知道", "我不是问天气", "不是问天气",
]
NEGATIVE_TICKET_PATTERNS = [
    "不要查票", "不用查票", "别查票", "先别查票", "不查票", "不要查车票", "不用查车票",
    "不要看车票", "不用看车票", "别看车票", "先别查车票", "先不查火车票", "不查火车票",
    "不用火车票", "不要火车票", "票的事情先放一边", "票先放一边", "车票我晚点自己看",
    "车票暂时不用", "火车票暂时不用",
]
TICKET_CHAR = "票"
ADMISSION_TICKET = "门票"
INVALID_SLOT_VALUES = ["", "未知", "未知城市", "未知日期", "未指定", "不清楚", "unknown", "null", "none"]
REQUIRED_SLOTS = {
    "weather_agent": ["city", "fx_date"],
    "ticket_agent": ["departure_city", "arrival_city", "travel_date"],
}
SLOT_NAMES = ["city", "fx_date", "departure_city", "arrival_city", "travel_date"]
SLOT_LABELS = {
    "city": "天气城市",
    "fx_date": "天气日期",
    "departure_city": "出发城市",
    "arrival_city": "到达城市",
    "travel_date": "出行日期",
}
CLARIFY_PREFIX = "请补充以下信息："
CLARIFY_SUFFIX = "。"
LABEL_SEPARATOR = "、"
INTENT_WEATHER = "weather_query"
INTENT_TICKET = "ticket_query"
INTENT_BOTH = "travel_planning"
INTENT_UNKNOWN = "unknown"

WEATHER_SLOT_KEYS = ["city", "fx_date"]
TICKET_SLOT_KEYS = ["departure_city", "arrival_city", "travel_date"]

# Slot aliases per agent, first non-empty wins.
TICKET_ALIASES = {
    "departure_city": ["departure_city", "origin", "from"],
    "arrival_city": ["arrival_city", "destination", "to"],
    "travel_date": ["travel_date", "date"],
}
WEATHER_ALIASES = {
    "city": ["city"],
    "fx_date": ["fx_date", "date", "weather_date"],
}

ARTIFACT_STATUSES = ["success", "not_found", "failed"]
REQUEST_STATUSES = ["success", "partial_success", "agent_failed", "need_clarification", "no_supported_agent"]

FORECAST_MAX_DAYS = 15
UNKNOWN_WEATHER_TEXT = "未知"
WEATHER_CODE_TEXT = {
    0: "晴", 1: "晴间多云", 2: "多云", 3: "阴",
    45: "雾", 48: "雾凇",
    51: "小毛毛雨", 53: "毛毛雨", 55: "大毛毛雨",
    56: "冻毛毛雨", 57: "强冻毛毛雨",
    61: "小雨", 63: "中雨", 65: "大雨",
    66: "冻雨", 67: "强冻雨",
    71: "小雪", 73: "中雪", 75: "大雪", 77: "雪粒",
    80: "小阵雨", 81: "阵雨", 82: "强阵雨",
    85: "小阵雪", 86: "大阵雪",
    95: "雷阵雨", 96: "雷阵雨伴冰雹", 99: "强雷阵雨伴冰雹",
}

# Artifact summaries. Placeholders are filled column-wise.
TICKET_SUMMARY = ("查询到 {departure_city} 到 {arrival_city} 的车票，共 {count} 个班次。"
                  "推荐参考 {train_number}，出发时间 {departure_time}，到达时间 {arrival_time}，"
                  "价格约 {price} {currency}，余票 {remaining_seats} 张。")
TICKET_DEFAULTS = {
    "departure_city": "未知出发地", "arrival_city": "未知目的地", "train_number": "未知车次",
    "departure_time": "未知出发时间", "arrival_time": "未知到达时间", "price": "未知价格",
    "remaining_seats": "未知",
}
# Messages of lookups without a row, and the final answer's prompt.
TICKET_NO_ROWS = "No train tickets found for {departure_city} -> {arrival_city} on {travel_date}"
WEATHER_NO_ROW = "No weather data found for city={city}, date={fx_date}"
# Fixed value: the analyzer's prompt.
ANALYZE_PROMPT = """
请分析下面的旅行/出行查询，并严格输出 JSON。

用户输入：
{query}

你需要完成：
1. 识别用户意图
2. 判断需要调用哪些 Agent
3. 提取槽位信息
4. 判断是否缺少必要信息
5. 如果缺少信息，生成追问问题

当前系统支持的 Agent：
- weather_agent：查询天气，必须需要 city 和 fx_date
- ticket_agent：查询火车票，必须需要 departure_city、arrival_city、travel_date

字段要求：
- intent 可以是 weather_query、ticket_query、travel_planning、multi_intent、unknown
- required_agents 只能从 weather_agent、ticket_agent 中选择
- fx_date 必须使用 YYYY-MM-DD 格式
- travel_date 必须使用 YYYY-MM-DD 格式
- 如果用户说“天气”，通常查询目的地城市的天气
- 只有用户明确查询“票”、“车票”、“新干线”、“火车票”、“列车”等铁路票务时，才调用 ticket_agent
- 用户提供出发地和目的地，不代表用户一定要查询火车票
- train_tickets 数据表只存储火车/高铁/新干线票，不存储飞机票
- “机票”、“航班”、“飞机”不属于 ticket_agent，不能调用 ticket_agent
- 如果用户说“不是机票/不是航班，而是火车票/高铁/新干线/列车”，这是铁路票务查询，应调用 ticket_agent
- 景点推荐当前不支持，不要返回不存在的 Agent

否定表达处理规则：
- 如果用户说“不要查天气”、“不用看天气”、“别看天气”、“先别查天气”、“不要天气预报”，不要调用 weather_agent。
- 如果用户说“不要查票”、“不用看车票”、“先别查票”、“先不查火车票”，不要调用 ticket_agent。
- 如果用户说“天气我已经知道了”、“我不是问天气”，不要调用 weather_agent。
- 如果用户说“票的事情先放一边”、“车票我晚点自己看”、“火车票暂时不用”，不要调用 ticket_agent。
- 如果一句话同时包含否定表达和肯定表达，以用户肯定要查询的部分为准。
- 示例：“不要查天气，只查火车票” => ticket_query，只调用 ticket_agent。
- 示例：“不用看车票，只看天气” => weather_query，只调用 weather_agent。

槽位提取规则：
- departure_city 表示出发城市
- arrival_city 表示到达城市 / 目的地城市
- city 表示天气查询或景点推荐使用的城市
- 如果用户表达“从A去B”，则 departure_city=A，arrival_city=B
- 如果用户同时查询天气和票务，weather_agent 的 city 通常等于 arrival_city
- 如果用户只说“去东京”，没有说明出发地，则 arrival_city=东京，但 departure_city 缺失
- 如果用户提供了日期，则 weather_agent 使用 fx_date，ticket_agent 使用 travel_date
- 如果同一个日期同时用于天气和票务，则 fx_date 和 travel_date 都填写这个日期
- 如果用户输入中包含“用户原始需求”和“用户补充信息”，请把两部分合并理解。
- 用户补充信息通常用于补全缺失的 city、fx_date、departure_city、arrival_city、travel_date。
- 不要把“用户原始需求”“用户补充信息”这些标题当成槽位内容。

缺失信息判断规则：
- weather_agent 必须有 city 和 fx_date。缺少任意一个，都要加入 missing_slots。
- ticket_agent 必须有 departure_city、arrival_city、travel_date。缺少任意一个，都要加入 missing_slots。
- 如果 missing_slots 不为空，need_clarification 必须为 true。
- clarification_question 要一次性询问所有缺失信息。
- 不要把“未知城市”、“未知日期”、“未指定”、“不清楚”、“unknown”、“null” 当作有效槽位。
- 如果无法确定某个槽位，就不要在 slots 中填写它，而是加入 missing_slots。
- 如果用户输入信息完整，missing_slots 必须为空数组，need_clarification 必须为 false。

输出要求：
- 只输出 JSON
- 不要输出 Markdown
- 不要输出解释
- 不要使用代码块
- slots 中只填写已经明确识别到的槽位
- required_agents 必须和用户意图一致

请严格输出如下 JSON 格式：

{
  "intent": "travel_planning",
  "required_agents": ["weather_agent", "ticket_agent"],
  "slots": {
    "departure_city": "富山",
    "arrival_city": "东京",
    "city": "东京",
    "fx_date": "2026-06-20",
    "travel_date": "2026-06-20"
  },
  "missing_slots": [],
  "need_clarification": false,
  "clarification_question": ""
}
示例1：
用户输入：帮我查一下天气
输出：
{
  "intent": "weather_query",
  "required_agents": ["weather_agent"],
  "slots": {},
  "missing_slots": ["city", "fx_date"],
  "need_clarification": true,
  "clarification_question": "请问你想查询哪个城市、哪一天的天气？"
}
示例2：
用户输入：我想2026-06-20从富山去东京，帮我看看天气和新干线票
输出：
{
  "intent": "travel_planning",
  "required_agents": ["weather_agent", "ticket_agent"],
  "slots": {
    "departure_city": "富山",
    "arrival_city": "东京",
    "city": "东京",
    "fx_date": "2026-06-20",
    "travel_date": "2026-06-20"
  },
  "missing_slots": [],
  "need_clarification": false,
  "clarification_question": ""
}
示例3：
用户输入：帮我查一下去东京的票
输出：
{
  "intent": "ticket_query",
  "required_agents": ["ticket_agent"],
  "slots": {
    "arrival_city": "东京"
  },
  "missing_slots": ["departure_city", "travel_date"],
  "need_clarification": true,
  "clarification_question": "请问你从哪个城市出发？计划哪一天去东京？"
}
"""

FINAL_PROMPT = """
你是一个旅行/出行规划助手。

请根据用户原始需求、RouterAgent 的意图识别结果，以及多个 Agent 返回的 artifacts，生成一段清晰、自然、实用的中文回答。

用户原始需求：
{query}

RouterAgent 识别结果：
{analysis}

Agent artifacts：
{artifacts}

回答要求：
1. 不要输出 JSON。
2. 不要提到内部技术名，例如 A2A、MCP、artifact、RouterAgent。
3. 直接面向用户回答。
4. 如果有天气信息，要说明天气、温度、降水、出行建议。
5. 如果有车票信息，要说明车次、出发时间、到达时间、价格、余票。
6. 如果同时有天气和车票信息，要整合成一个完整建议。
7. 语气自然，适合旅行助手。
8. 不要编造 artifacts 里没有的数据。
"""

TICKET_NONE_SUMMARY = "没有查询到车票数据。"
TICKET_MISSING_SUMMARY = "票务查询缺少必要参数。"
TICKET_NOT_FOUND_SUMMARY = "没有查询到 {departure_city} 到 {arrival_city} 在 {travel_date} 的车票。"
DEFAULT_CURRENCY = "日元"
WEATHER_SUMMARY = ("{city} {fx_date} 白天天气为{text_day}，气温约 {temp_min}-{temp_max}°C，"
                   "湿度 {humidity}%，降水量 {precip}mm。")
WEATHER_DEFAULTS = {
    "city": "未知城市", "fx_date": "未知日期", "text_day": "未知天气", "temp_min": "未知",
    "temp_max": "未知", "humidity": "未知", "precip": "未知",
}
WEATHER_NONE_SUMMARY = "没有查询到天气数据。"
WEATHER_MISSING_SUMMARY = "天气查询缺少 city 或 fx_date 参数。"
WEATHER_NOT_FOUND_SUMMARY = "没有查询到 {city} {fx_date} 的天气数据。"

# Follow-up texts for dialog context (web: original + question + reply;
# terminal: original + reply, nested).
FOLLOWUP_WEB = ("\n用户原始需求：\n{original}\n\n系统追问：\n{question}\n\n用户补充信息：\n{reply}\n\n"
                "请结合用户原始需求和用户补充信息，重新理解完整需求。\n")
FOLLOWUP_CLI = ("\n用户原始需求：\n{original}\n\n用户补充信息：\n{reply}\n\n"
                "请结合原始需求和补充信息，重新理解用户完整需求。\n")

# Evaluation case plan: family sizes.
CASE_COUNTS = {
    "weather": 11,
    "ticket": 19,
    "combined": 15,
    "missing_slots": 22,
    "unsupported": 15,
    "routing_edge": 18,
}

WEATHER_TEMPLATES = [
    "{date} {city}天气怎么样？",
    "帮我查一下{city}{date}的天气预报。",
    "我想看看{date}{city}会不会下雨。",
    "{city}在{date}的气温大概是多少？",
    "查询{city}{date}天气和湿度。",
    "{date}去{city}，帮我看天气。",
    "看一下{date}{city}白天天气。",
    "{city}{date}温度如何？",
    "我需要{city}在{date}的天气信息。",
    "{date}{city}有降雨吗？",
    "帮我看看{city}{date}适不适合出行。",
]
TICKET_TEMPLATES = [
    "{date}从{dep}到{arr}有火车票吗？",
    "帮我查{date}{dep}去{arr}的车票。",
    "我想{date}从{dep}出发去{arr}，看一下列车。",
    "{dep}到{arr}{date}的新干线还有票吗？",
    "查一下{date}{dep}到{arr}的火车班次。",
    "{date}我要从{dep}去{arr}，帮我看车票。",
    "帮忙看看{dep}到{arr}在{date}有没有列车。",
    "查询{date}{dep}前往{arr}的火车票。",
    "{date}{dep}去{arr}，还有余票吗？",
    "看一下{dep}到{arr}{date}的铁路票务。",
    "帮我找{date}{dep}出发到{arr}的班次。",
    "{dep}到{arr}的火车票，日期是{date}。",
    "我需要{date}从{dep}前往{arr}的列车信息。",
    "{date}{dep}去{arr}有没有高铁？",
    "查{dep}到{arr}{date}剩余车票。",
    "{date}从{dep}坐火车到{arr}，票还有吗？",
    "帮我看看{date}{dep}到{arr}的动车。",
    "查询{dep}去{arr}，{date}的车次。",
    "{date}{dep}到{arr}铁路班次帮我看下。",
]
COMBINED_TEMPLATES = [
    "{date}从{dep}去{arr}，帮我查天气和火车票。",
    "我想{date}{dep}到{arr}旅行，看下{arr}天气和车票。",
    "{date}{dep}出发去{arr}，天气和列车都帮我看一下。",
    "帮我规划{date}从{dep}去{arr}，要天气和火车信息。",
    "{date}去{arr}，我从{dep}出发，查天气顺便查票。",
    "看看{date}{dep}到{arr}的火车票，还有{arr}天气。",
    "我准备{date}从{dep}去{arr}，帮我一起查天气和车次。",
    "{date}{dep}前往{arr}，查一下目的地天气和火车票。",
    "从{dep}去{arr}，{date}天气和余票都帮我看下。",
    "{date}我要从{dep}到{arr}，查一下{arr}天气以及列车。",
    "帮我看{date}{dep}到{arr}的火车票，再看目的地天气。",
    "计划{date}从{dep}去{arr}，需要车票和天气。",
    "{date}{dep}出发到{arr}，帮我做个简单出行查询。",
    "我想{date}从{dep}去{arr}，天气和火车班次都要。",
    "{dep}到{arr}{date}出行，查票并看天气。",
]

# Missing-slot cases, in order: (template, sample source, sample index, intent,
# agents, kept slots as slot=row field, missing slots). Sources: "w" = 6 even
# picks of the weather keys, "t" = 12 even picks of the routes, None = none.
MISSING_SLOT_SPECS = [
    ("帮我查一下天气。", None, None, "weather_query", ["weather_agent"], [], ["city", "fx_date"]),
    ("帮我查{city}天气。", "w", 0, "weather_query", ["weather_agent"], ["city=city"], ["fx_date"]),
    ("看一下{date}的天气。", "w", 1, "weather_query", ["weather_agent"], ["fx_date=fx_date"], ["city"]),
    ("{city}会不会下雨？", "w", 2, "weather_query", ["weather_agent"], ["city=city"], ["fx_date"]),
    ("{date}温度怎么样？", "w", 3, "weather_query", ["weather_agent"], ["fx_date=fx_date"], ["city"]),
    ("我想查火车票。", None, None, "ticket_query", ["ticket_agent"], [], ["departure_city", "arrival_city", "travel_date"]),
    ("帮我查去{arr}的火车票。", "t", 0, "ticket_query", ["ticket_agent"], ["arrival_city=arrival_city"], ["departure_city", "travel_date"]),
    ("{date}去{arr}的车票帮我看一下。", "t", 1, "ticket_query", ["ticket_agent"], ["arrival_city=arrival_city", "travel_date=travel_date"], ["departure_city"]),
    ("从{dep}到{arr}有火车票吗？", "t", 2, "ticket_query", ["ticket_agent"], ["departure_city=departure_city", "arrival_city=arrival_city"], ["travel_date"]),
    ("{date}从{dep}出发的车票。", "t", 3, "ticket_query", ["ticket_agent"], ["departure_city=departure_city", "travel_date=travel_date"], ["arrival_city"]),
    ("从{dep}出发的火车票。", "t", 4, "ticket_query", ["ticket_agent"], ["departure_city=departure_city"], ["arrival_city", "travel_date"]),
    ("{date}从{dep}坐火车。", "t", 5, "ticket_query", ["ticket_agent"], ["departure_city=departure_city", "travel_date=travel_date"], ["arrival_city"]),
    ("去{arr}，查火车票。", "t", 6, "ticket_query", ["ticket_agent"], ["arrival_city=arrival_city"], ["departure_city", "travel_date"]),
    ("我想从{dep}去{arr}，查天气和车票。", "t", 7, "travel_planning", ["weather_agent", "ticket_agent"], ["departure_city=departure_city", "arrival_city=arrival_city", "city=arrival_city"], ["fx_date", "travel_date"]),
    ("{date}去{arr}，帮我查天气和火车票。", "t", 8, "travel_planning", ["weather_agent", "ticket_agent"], ["arrival_city=arrival_city", "city=arrival_city", "fx_date=travel_date", "travel_date=travel_date"], ["departure_city"]),
    ("从{dep}出发，查目的地天气和车票。", "t", 9, "travel_planning", ["weather_agent", "ticket_agent"], ["departure_city=departure_city"], ["arrival_city", "city", "fx_date", "travel_date"]),
    ("{date}从{dep}出发，查天气和火车。", "t", 10, "travel_planning", ["weather_agent", "ticket_agent"], ["departure_city=departure_city", "fx_date=travel_date", "travel_date=travel_date"], ["arrival_city", "city"]),
    ("去{arr}，帮我看天气和车票。", "t", 11, "travel_planning", ["weather_agent", "ticket_agent"], ["arrival_city=arrival_city", "city=arrival_city"], ["departure_city", "fx_date", "travel_date"]),
    ("{city}天气预报。", "w", 4, "weather_query", ["weather_agent"], ["city=city"], ["fx_date"]),
    ("{date}查一下天气情况。", "w", 5, "weather_query", ["weather_agent"], ["fx_date=fx_date"], ["city"]),
    ("帮我看一下火车班次。", None, None, "ticket_query", ["ticket_agent"], [], ["departure_city", "arrival_city", "travel_date"]),
    ("帮我查一下出行天气和火车票。", None, None, "travel_planning", ["weather_agent", "ticket_agent"], [], ["city", "fx_date", "departure_city", "arrival_city", "travel_date"]),
]

UNSUPPORTED_QUERIES = [
    "帮我订一张北京到上海的机票。",
    "我想预订广州的酒店。",
    "推荐一下深圳适合周末去的景点。",
    "上海有什么好吃的餐厅？",
    "帮我规划东京三日游景点路线。",
    "北京到广州的航班还有吗？",
    "我想买演唱会门票。",
    "你好，随便聊聊天。",
    "帮我找北京附近的民宿。",
    "广州有什么博物馆推荐？",
    "深圳有哪些适合拍照的地方？",
    "上海酒店价格帮我查一下。",
    "东京有哪些热门景区？",
    "帮我写一份旅行文案。",
    "北京飞上海的飞机几点起飞？",
]

# Routing-edge cases, in order: (template, sample source, sample index, intent,
# agents). Sources: "r" = 10 even picks of all routes, "c" = 8 even picks of the
# routes whose arrival city and day have a weather row. Slots are complete:
# ticket agents get dep, arr, date; weather agents get city=arr, fx_date=date.
EDGE_SPECS = [
    ("不要查天气，只查{date}从{dep}到{arr}的火车票。", "r", 0, "ticket_query", ["ticket_agent"]),
    ("票的事情先放一边，我只关心{arr}{date}天气。", "c", 0, "weather_query", ["weather_agent"]),
    ("景点攻略之后再说，先帮我看{arr}{date}天气。", "c", 1, "weather_query", ["weather_agent"]),
    ("我不是要机票，是要{dep}到{arr}{date}的火车票。", "r", 1, "ticket_query", ["ticket_agent"]),
    ("我在做攻略，不过这一轮只需要{date}{arr}天气。", "c", 2, "weather_query", ["weather_agent"]),
    ("酒店我已经订好了，帮我查{date}{dep}去{arr}的列车。", "r", 2, "ticket_query", ["ticket_agent"]),
    ("{date}从{dep}去{arr}，景点先不用管，天气和车票都查。", "c", 3, "travel_planning", ["weather_agent", "ticket_agent"]),
    ("不是航班，查{date}{dep}到{arr}的新干线票。", "r", 3, "ticket_query", ["ticket_agent"]),
    ("车票我晚点自己看，你先告诉我{arr}{date}会不会下雨。", "c", 4, "weather_query", ["weather_agent"]),
    ("天气我已经知道了，现在只要{dep}到{arr}{date}余票。", "r", 4, "ticket_query", ["ticket_agent"]),
    ("酒店不用管，查{date}{dep}到{arr}车票。", "r", 5, "ticket_query", ["ticket_agent"]),
    ("不是旅游攻略，只查{arr}{date}天气。", "c", 5, "weather_query", ["weather_agent"]),
    ("机票不合适，看看{date}{dep}去{arr}火车票。", "r", 6, "ticket_query", ["ticket_agent"]),
    ("餐厅推荐之后再聊，先看{arr}{date}气温。", "c", 6, "weather_query", ["weather_agent"]),
    ("{date}从{dep}去{arr}，不是机票，查天气和火车。", "c", 7, "travel_planning", ["weather_agent", "ticket_agent"]),
    ("我不是问天气，查{date}{dep}到{arr}列车余票。", "r", 7, "ticket_query", ["ticket_agent"]),
    ("火车票暂时不用，你告诉我{arr}{date}天气就行。", "c", 0, "weather_query", ["weather_agent"]),
    ("航班信息不用管，帮我查{dep}到{arr}{date}火车。", "r", 8, "ticket_query", ["ticket_agent"]),
]
EDGE_SAMPLE_SIZES = {"r": 10, "c": 8}
MISSING_SAMPLE_SIZES = {"w": 6, "t": 12}

# Log vocabulary: timer names, call events and outcomes.
TIMER_NAMES = ["LLM analyze_query", "A2A agent calls", "LLM final_answer"]
CALL_START_EVENTS = ["a2a_call_start", "llm_call_start"]
CALL_SUCCESS_EVENTS = ["a2a_call_success", "llm_call_success"]
CALL_ERROR_EVENTS = ["a2a_call_error", "llm_call_error"]
