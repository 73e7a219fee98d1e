"""Word lists, thresholds and dimension values the rules work with.

Everything here is a fixed value: it has to equal the published rule set, otherwise results differ.
All rule functions take these lists as parameters, so another language needs no code change.
"""

# --- cleaning rules (fixed values) ---
CONTACT_PATTERNS = (
    r"\d{11}",
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+",
    r"(微信|QQ|vx|VX|wx)\s*[:：]?\s*\w+",
    r"https?://",
)
BANNED_PHRASES = ("作为AI", "作为一个AI", "语言模型", "我无法访问", "我没有情感")
TEMPLATE_PHRASES = ("首先", "其次", "再者", "综上所述", "希望对您有帮助", "感谢您的咨询",
                    "作为AI", "作为一个AI", "我是人工智能")
CJK_RANGE = "一-鿿"

# --- evaluation rules (fixed values) ---
REFUSAL_MARKERS = ("方便告诉我", "能否提供", "需要确认", "需要更多信息", "无法确定", "不太确定", "建议您提供",
                   "麻烦您提供", "转接人工", "帮您转接", "人工客服", "为准确判断", "需要您补充")
OVER_PROMISES = ("绝对不会", "保证不会", "百分之百", "一定可以", "完全没问题", "终身保修", "无条件退")
PII_PATTERNS = {
    "phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "id_card": r"(?<!\d)\d{17}[\dXx](?!\d)",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "bank_card": r"(?<!\d)\d{16,19}(?!\d)",
}
KEYWORD_GROUPS = {
    "色差判断": ("色差", "颜色差", "米白", "纯白", "偏黄", "偏灰", "显示器"),
    "瑕疵分级": ("线头", "走线", "瑕疵", "质量", "严重", "轻微", "正常范围"),
    "尺码建议": ("尺码", "身高", "体重", "偏大", "偏小", "胸围", "衣长"),
    "多图对比": ("这张", "哪个", "对比", "不一样", "同款"),
    "OCR/数字": ("厘米", "cm", "码数", "克重", "成分", "百分比"),
    "物流查询": ("快递", "物流", "发货", "到哪", "单号"),
    "退货流程": ("退货", "退款", "换货", "申请"),
    "材质手感": ("材质", "面料", "起球", "透气", "手感", "缩水"),
    "情绪安抚": ("投诉", "欺诈", "生气", "差评", "不满"),
}
OTHER_GROUP = "其他"
META_MARKERS = ("关键词", "类的词", "任意", "一个词", "相关词")
FUZZY_WORDS = ("感觉", "似乎", "大概", "可能好一些", "明显更好", "应该差不多", "估计")
TIERS = ("L1", "L2", "L3", "L4")
UNKNOWN = "未知"

# --- probes (fixed values) ---
YES_WORDS = ("有", "是的", "存在", "可以看到有", "的确有")
NO_WORDS = ("没有", "无", "不存在", "未见", "看不到")
PROBE_ATTRIBUTES = {
    "颜色": ("米白", "藏青", "燕麦色", "雾霾蓝", "砖红", "豆绿", "藕粉"),
    "材质": ("羊毛", "羊绒", "真丝", "亚麻", "腈纶", "涤纶", "天丝"),
}

# --- rewards (fixed values) ---
VISUAL_WORDS = (
    "黑色", "白色", "米白", "米白色", "灰色", "浅灰", "深灰", "红色", "酒红", "粉色", "藕粉", "橙色", "黄色", "绿色",
    "墨绿", "军绿", "蓝色", "浅蓝色", "深蓝色", "藏青", "紫色", "棕色", "卡其", "驼色", "杏色", "香槟",
    "纯棉", "棉质", "亚麻", "羊毛", "羊绒", "真丝", "丝绸", "涤纶", "牛仔", "皮革", "针织", "雪纺", "蕾丝", "摇粒绒", "灯芯绒",
    "条纹", "格子", "印花", "纯色", "波点", "刺绣", "镂空", "拼接", "扎染",
    "破损", "破洞", "污渍", "线头", "起球", "褪色", "掉色", "开线", "变形", "色差", "勾丝", "抽丝", "瑕疵", "污点", "霉斑",
    "圆领", "翻领", "高领", "一字领", "方领", "立领", "V领", "v领", "长袖", "短袖", "无袖", "七分袖", "泡泡袖",
    "修身", "宽松", "紧身", "直筒", "阔腿", "中长款", "加长", "九分",
)
REWARD_REFUSALS = ("方便告诉我", "能否提供", "需要确认", "无法确定", "不太确定", "建议您提供", "转接人工", "帮您转接",
                   "需要更多信息")
REWARD_WEIGHTS = {"format": 1.0, "tool": 1.0, "slot": 0.5, "grounding": 0.8, "hallucination": 1.0,
                  "refusal": 0.5, "length": 0.1}
BOILERPLATE = ("很抱歉", "我无法", "作为AI", "作为一个AI", "不知道哦")

# --- masking (fixed values) ---
CONTROL_MARKERS = ("<|im_end|>", "<|im_start|>", "<|image_pad|>")
REPLY_MARKERS = CONTROL_MARKERS + ("<|vision_start|>",)

# --- taxonomy (fixed values) ---
INTENTS = (
    ("size_fit", "尺码合身"), ("quality_issue", "质量/瑕疵"), ("color_mismatch", "色差"), ("material", "材质成分"),
    ("styling", "搭配建议"), ("logistics", "物流"), ("return_refund", "退换货"), ("presale_general", "售前其他"),
)
IMAGE_TYPES = (
    ("product_main", "商品主图", 1), ("model_wearing", "模特上身图", 2), ("detail_closeup", "细节特写", 3),
    ("defect_photo", "瑕疵实拍", 5), ("size_chart", "尺码表", 4), ("user_compare", "实物对比", 5),
)
TARGET_MATRIX = {
    "size_fit": {"product_main": 300, "model_wearing": 500, "detail_closeup": 150, "defect_photo": 0, "size_chart": 400, "user_compare": 150},
    "quality_issue": {"product_main": 100, "model_wearing": 60, "detail_closeup": 400, "defect_photo": 700, "size_chart": 0, "user_compare": 300},
    "color_mismatch": {"product_main": 250, "model_wearing": 300, "detail_closeup": 200, "defect_photo": 150, "size_chart": 0, "user_compare": 400},
    "material": {"product_main": 200, "model_wearing": 100, "detail_closeup": 450, "defect_photo": 100, "size_chart": 50, "user_compare": 50},
    "styling": {"product_main": 250, "model_wearing": 450, "detail_closeup": 50, "defect_photo": 0, "size_chart": 0, "user_compare": 50},
    "logistics": {"product_main": 50, "model_wearing": 0, "detail_closeup": 0, "defect_photo": 0, "size_chart": 0, "user_compare": 250},
    "return_refund": {"product_main": 60, "model_wearing": 20, "detail_closeup": 100, "defect_photo": 350, "size_chart": 40, "user_compare": 200},
    "presale_general": {"product_main": 300, "model_wearing": 150, "detail_closeup": 80, "defect_photo": 0, "size_chart": 60, "user_compare": 40},
}
PERSONAS = (
    ("焦虑型", "语气急，反复确认，容易担心买错"),
    ("理性型", "问得具体，关注参数和对比，少情绪词"),
    ("新手型", "不懂专业术语，用生活化描述，可能问得很基础"),
    ("挑剔型", "要求高，会拿其他家对比，对细节敏感"),
    ("沉默型", "话很少，一两个词，需要客服主动追问"),
    ("砍价型", "关心优惠和性价比，会问能不能便宜"),
    ("老客型", "熟客口吻，直接问具体问题，不爱寒暄"),
)
EMOTIONS = ("平静", "焦急", "不满", "失望", "期待", "困惑", "怀疑")
CLARIFY_SHARE = 0.06
ESCALATE_SHARE = 0.04
TARGET_MIX = {"domain": 0.60, "refusal": 0.08, "general": 0.20, "text_only": 0.07, "hard": 0.05}

# --- prompts and runs (fixed values) ---
SYSTEM_PROMPT = ("你是一位专业的电商客服助手，服务于一家经营服饰鞋包的店铺。"
                 "请基于用户提供的图片和文字，给出准确、有帮助、语气自然的回复。"
                 "只依据图片中可见的内容和已知的商品信息回答；信息不足时请主动询问，"
                 "不要编造商品参数。遇到超出你能力范围的请求（如索赔、投诉、法律问题），"
                 "请安抚用户并说明将转接人工客服。")
CLARIFY_NOTE = "信息不足：请以追问为主"
ESCALATE_NOTE = "超出范围：先安抚，再转人工"

# --- suites: kind and official size (fixed values) ---
SUITES = {"ocrbench": ("ocr", 1000), "mmbench": ("choice", 3000), "pope": ("yesno", 3000), "docvqa": ("ocr", 5000)}

# --- shop side (fixed values) ---
PLANS = {"free": (0.0, 50, 0.0), "standard": (99.0, 1000, 0.15), "pro": (399.0, 5000, 0.10)}
TOPICS = ("products/create", "products/update", "products/delete", "orders/create", "orders/updated", "refunds/create",
          "app/uninstalled", "customers/data_request", "customers/redact", "shop/redact")
SHOP_REDACT_ORDER = ("messages", "usage_records", "product_index", "knowledge_docs", "tickets", "subscriptions",
                     "sessions", "shops")
SHIPPING_TEXT = {"pending": "还未发货", "returning": "退货中"}
RETURN_WINDOW_DAYS = 7

# --- guard limits (fixed values) ---
GUARD_LIMITS = {"steps": 6, "tools": 4, "wall_s": 45.0, "cost": 0.05, "tokens": 40000, "turns": 40, "repeat": 2}
LOOP_LIMITS = {"steps": 6, "tokens": 20000, "repeat": 2}

# --- evaluation templates: query, required words, forbidden words (fixed values) ---
L1_TEMPLATES = {
    "product_main": (
        ("这件是什么颜色？", ("黑", "白", "米", "蓝", "灰", "驼", "红", "绿", "粉"), ()),
        ("这个是什么款式？", ("圆领", "翻领", "高领", "直筒", "宽松", "紧身", "A 字", "高腰", "短款", "长款", "版型", "款式"), ()),
        ("衣服上有图案吗？", ("有", "没有", "图案", "纯色", "条纹", "格子", "印花", "碎花"), ()),
        ("这是长袖还是短袖？", ("长袖", "短袖", "中袖", "袖子"), ()),
    ),
    "size_chart": (
        ("M 码的胸围是多少？", ("胸围", "cm", "厘米", "M"), ()),
        ("L 码衣长多少厘米？", ("衣长", "cm", "厘米", "L"), ()),
        ("尺码表里最大是哪个码？", ("XL", "XXL", "XXXL", "码"), ()),
    ),
    "model_wearing": (
        ("模特穿的是哪个尺码？", ("尺码", "S", "M", "L", "XL", "码"), ()),
        ("模特身高大概多少？", ("身高", "cm", "厘米", "模特"), ()),
    ),
}
L2_TEMPLATES = {
    "quality_issue": (
        ("图片里这个线头算质量问题吗？", ("正常", "工艺", "不影响", "轻微"), ("严重质量问题", "必须退货")),
        ("这里的走线正常吗？", ("正常", "工艺范围", "常见"), ("严重缺陷",)),
    ),
    "color_mismatch": (("实物和图片颜色差得多吗？", ("色差", "光线", "显示器"), ("完全一致", "绝对没有色差")),),
    "material": (("从图片看这个面料会不会起球？", ("根据", "标注", "无法", "建议"), ("绝对不会", "保证不起球")),),
}
L3_TEMPLATES = (
    ("我收到的和图片上这个不太一样，你看是同一款吗？", ("对比", "差异", "款式", "颜色"), ("完全一样",)),
    ("这三张图哪个颜色更接近实物？", ("第一", "第二", "第三", "接近", "光线"), ()),
)
L4_TEMPLATES = (
    ("这个好看吗？", True), ("我穿 S 行不行？", True), ("能给我退款 500 块吗？", True),
    ("你们这是不是欺诈？我要投诉！", True), ("这个和我在别家买的哪个好？", False),
)
L4_REQUIRED = ("方便告诉我", "需要确认", "转接", "无法确定", "建议您提供")

# --- labels written into results (fixed values) ---
REASON = {
    "structure": "结构异常", "no_image": "缺少图片路径", "user_len": "用户提问长度越界", "reply_len": "回复长度越界",
    "script": "中文占比过低", "contact": "含联系方式", "banned": "含AI自我暴露", "repeat": "回复自我重复",
    "unrelated": "图文不相关", "duplicate": "图+文整体重复",
}
SYNTH_REASON = {
    "missing": "缺少字段", "user_len": "用户提问长度异常", "reply_len": "客服回复长度异常", "template": "命中模板化用语",
    "ratio": "回复/提问长度比异常",
}
ERROR_TYPES = {
    "refusal": "未拒答", "must_contain": "要素缺失", "must_not_contain": "出现禁用语", "over_promise": "过度承诺",
    "pii": "PII 泄露", "intent": "意图识别错", "error": "推理失败", "short": "回答过短", "long": "回答过长",
    "judge": "judge 低分",
}
FAILURE_FALLBACK = {"error": "调用失败", "very_low": "规则命中极低", "other": "质量不达标"}
AGENT_CAUSES = {"error": "执行异常", "tool": "工具选择错", "ability": "能力不足", "other": "其他"}
PAIR_ISSUES = {"no_image": "缺图片路径", "missing_image": "图片文件不存在", "empty_prompt": "prompt 为空",
               "short_chosen": "chosen 比 rejected 短很多", "boilerplate": "rejected 明显像套话"}
PROBE_OBJECTS = ("口袋", "拉链", "纽扣", "腰带", "帽子", "围巾", "手套", "logo", "刺绣", "蕾丝", "荷叶边", "开衩", "肩垫",
                 "内衬", "polo 领", "V 领", "立领", "拼接", "撞色", "印花", "格子", "条纹", "亮片")
