"""Labels, prompt lines, word lists and field names that results depend on."""

SHOT_FIELDS = ("index", "shot_scale", "camera_angle", "camera_motion", "subjects", "background",
               "description_narrative", "dialogue", "speaker", "emotion", "duration")
CONTENT_FIELDS = ("shot_scale", "camera_angle", "camera_motion", "subjects", "background", "description_narrative")
TEXT_FIELDS = ("shot_scale", "camera_angle", "camera_motion", "background", "description_narrative", "dialogue",
               "speaker", "emotion")
SUBJECT_FIELDS = ("name", "gender", "clothing", "position", "action", "expression")

VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv", "flv", "wmv", "ts", "m4v")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")

IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".webp")
SUCCESS_STATES = ("SUCCESS",)
RUNNING_STATES = ("QUEUED", "RUNNING")

PLOT_TITLE = "剧情摘要"
CAST_TITLE = "出场角色"
STATIC_MOTION = "固定"
NONE_LINE = "  （无）"
NO_PLOT = "（无）"
NO_DIALOGUE = "（无台词）"

LENS_WORDS = "特写|近景|中景|远景|全景|中近景|大特写|大全景|俯拍|仰拍|平拍|斜角|跟拍|推进|拉远|摇镜|移镜|升降镜头"
ACTION_WORDS = ("走向|奔跑|转身|回头|低头|抬头|挥手|点头|摇头|站起|坐下|拥抱|"
                "握手|推开|扑倒|摔落|颤抖|凝视|微笑|皱眉|哭泣|大笑|呼喊")
TEMPORAL_WORDS = "随即|随后|紧接|转而|此时|片刻后|慢慢|逐渐|突然|瞬间|同时|缓缓"

MISSING_SHOT = "shot文件缺失（分析失败或未运行）"
MISSING_FILE = "文件缺失"
COUNT_MISMATCH = "分镜数量不一致"

REPAIR_HEAD = "你是一位专业的影视台词校对师。以下是一集短剧的相关信息：\n\n【人物表】\n"
REPAIR_PLOT = "\n\n【剧情梗概】\n  "
REPAIR_DIALOGUE = "\n\n【台词参考（可能内容不全，但是内容正确）】\n"
REPAIR_INPUT = "\n\n【待修复的分镜台词（ASR语音识别结果，可能含错误）】\n"
REPAIR_RULES = (
    "\n\n【修复规则】\n"
    "1. 对照【台词参考】，修正分镜台词中的音近字、人名错误、语义不通等识别错误。\n"
    "2. 空字符串的分镜保持为空字符串，不要填入任何内容。\n"
    "3. 保持每条台词的简洁性，不要扩写或添加原文没有的内容。\n"
    "4. 分镜编号（JSON 的 key）保持不变，数量与顺序必须与输入完全一致。\n\n"
    "【输出格式硬性要求】\n"
    "- 直接输出修复后的 JSON 对象，严禁输出任何解释、前言或 markdown 代码块。\n"
    "- 严格按照以下骨架格式输出：\n")
RETRY_OBJECT = ("\n\n⚠️ 再次提醒：输出的JSON必须恰好包含 ", " 个key，最大index为 ", "。")
RETRY_ARRAY = ("\n\n⚠️ 再次提醒：输出的JSON数组必须恰好包含 ", " 个对象，最大index为 ", "。")

CONTROL_DEPTH = "使用图1深度图控制图约束空间结构"
CONTROL_POSE = "使用图2骨架图控制图约束人物姿态，必须遵守着两条约束条件"
CONTROL_NONE = "无控制图，仅基于文本"
CONTROL_HEAD = "请生成该镜头的首帧高质量图像。\n镜头描述："
CONTROL_HINT = "\n控制条件："
CONTROL_TAIL = "\n要求：写实风格、主体清晰、构图稳定，便于后续视频模型以该首帧继续生成。"

CHARACTER_TAIL = ("\n补充要求：输出竖版9:16单人角色参考图，人物完整入镜，服装和外观特征稳定，背景简洁干净，"
                  "适合作为后续分镜角色一致性参考。")
FRAME_REFS = "角色参考要求："
FRAME_REF = ("使用图", "作为角色参考图，保持角色 ", " 的外观、脸部特征和服装一致。")
FRAME_DEPTH = ("使用图", "深度图作为空间结构参考，优先用于指导场景层次、透视关系和整体空间布局。")
FRAME_ENVIRONMENT = (
    ("使用图", "骨架图仅作为轻度构图参考，不要据此生成任何人物、人体局部或人形轮廓。"),
    "这是纯环境镜头，画面中不得出现任何人物；如果骨架图与文本描述冲突，必须以文本描述为主，忽略其中会引入人物的姿态信息。")
FRAME_PEOPLE = (
    ("使用图", "骨架图作为人物姿态参考，优先用于指导人物大体动作和肢体朝向。"),
    "人物动作可以参考骨架图，但不能完全依赖骨架图；如果骨架图与文本描述存在不一致，以文本描述为主，仅吸收其中可用的动作和姿态信息，不要机械照搬控制图。",
    "人物动作要符合自然规律，姿态自然得体，肢体关系协调，不要过于僵硬、夸张或不自然。",
    "深度图虽然用于指导空间结构和透视关系，但不能因此破坏人物的正常尺度；如果深度图导致人物比例失衡或前后景人物尺寸差异过度，仍应以自然真实的人物比例为主。",
    "人物构图要求：两个人物处于同一真实场景空间中，人物比例必须正常，身高差与透视关系自然。",
    "角色一致性要求：人物的发色、发型与角色参考图保持一致，不要擅自改变头发颜色。")
FRAME_TAIL = (
    "画面中不要出现任何文字、字幕、对白气泡或其他可读文本。",
    "补充要求：输出竖版首帧图像，写实风格，主体清晰，构图稳定，整体画面表达以文本内容为最高优先级。")

JUDGE_INTRO = (
    ("请对以下 ", " 组分镜序列整体打分。\n"),
    ("你必须返回一个完整 JSON 数组，且只包含这 ", " 个对象；index 必须严格且完整地覆盖 ",
     "，每个 index 恰好出现一次，不得缺失、不得重复、不得输出额外 index。\n"),
    "输出要求：\n"
    "1. 顶层必须是 JSON 数组\n"
    "2. 每个元素格式必须为 {\"index\": 序号, \"score\": 0~1浮点数, \"reasoning\": \"不超过200字的评分理由\"}\n"
    "3. 不要输出任何 JSON 之外的解释、前后缀、markdown 代码块\n"
    "完整输出格式示例如下（请严格保留全部 index，只替换 score 和 reasoning 的内容）：\n[\n ")
JUDGE_ITEM = ("{\"index\": ", ", \"score\": 0.00, \"reasoning\": \"示例理由\"}")
