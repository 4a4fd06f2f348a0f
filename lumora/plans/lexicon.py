"""Fixed values of the query planner: words that it looks for, and what they stand for in English prompts."""

#: Marks of a companion, and what ends a name.
PERSON_MARKERS = ("和", "与", "跟")
PERSON_ENDS = r"在|拍|的|合影|照片|图片|素材|一起|\s"
NO_PERSONS = ("合影", "照片", "图片", "素材", "一起", "去年", "今年", "冬天", "夏天")

#: Fixed values.
TIME_WORDS = (
    "去年 今年 前年 春天 夏天 秋天 冬天 上午 中午 下午 晚上 夜晚 周末"
).split()

#: Fixed values.
LOCATION_WORDS = (
    "故宫 长城 天安门 颐和园 学校 教室 办公室 海边 沙滩 公园 商场 餐厅 城市 街道 山 湖"
).split()

#: Fixed values.
SCENE_WORDS = (
    "合影 自拍 人像 风景 建筑 雪景 夜景 蓝天 草地 瀑布 海浪 美食 做饭 烹饪 咖啡 聚餐 运动 篮球 足球 跳舞 会议 访谈 采访 对话 演讲 讲座 汇报 字幕 语音 转写 解说 旅行 毕业 宠物 车辆 花"
).split()

#: Fixed values.
OBJECT_WORDS = (
    "狗 猫 公交车 巴士 汽车 车 摩托车 自行车 飞机 火车 鸟 动物 马 牛 羊 披萨 三明治 蛋糕 香蕉 苹果 西兰花 胡萝卜 人 孩子 男人 女人 篮球 足球 咖啡 水果 方块 球"
).split()

#: Fixed values.
LOCATION_PROMPTS = {
    "故宫": ["Forbidden City", "Chinese imperial palace", "traditional Chinese palace architecture"],
    "长城": ["Great Wall of China"],
    "天安门": ["Tiananmen Square"],
    "颐和园": ["Summer Palace in Beijing", "Chinese garden"],
    "学校": ["school campus"],
    "教室": ["classroom"],
    "办公室": ["office"],
    "海边": ["beach", "seaside", "ocean coast"],
    "沙滩": ["sand beach"],
    "公园": ["park"],
    "商场": ["shopping mall"],
    "餐厅": ["restaurant"],
    "城市": ["city street", "urban scene"],
    "街道": ["street"],
    "山": ["mountain"],
    "湖": ["lake"],
}

#: Fixed values.
SCENE_PROMPTS = {
    "合影": ["group photo", "people posing together", "portrait of several people"],
    "自拍": ["selfie", "self portrait"],
    "人像": ["portrait photo", "person"],
    "风景": ["landscape photo", "scenery"],
    "建筑": ["architecture", "building"],
    "雪景": ["snowy scene", "snow landscape"],
    "夜景": ["night scene", "city lights at night"],
    "蓝天": ["blue sky"],
    "草地": ["grass field"],
    "瀑布": ["waterfall"],
    "海浪": ["ocean waves", "sea waves"],
    "美食": ["food", "meal"],
    "做饭": ["cooking"],
    "烹饪": ["cooking"],
    "咖啡": ["coffee"],
    "聚餐": ["people eating together", "dinner gathering"],
    "运动": ["sports", "running"],
    "篮球": ["basketball"],
    "足球": ["football", "soccer"],
    "水果": ["fruit"],
    "跳舞": ["dance"],
    "会议": ["meeting", "conference room"],
    "访谈": ["interview", "talk show", "speaker conversation"],
    "采访": ["interview", "journalism interview", "reporter talking to guest"],
    "对话": ["conversation", "people talking"],
    "演讲": ["lecture", "presentation", "speaker on stage"],
    "讲座": ["lecture", "education talk", "speaker presentation"],
    "汇报": ["presentation", "conference talk", "slides"],
    "字幕": ["subtitle", "caption text", "text on screen"],
    "语音": ["speech", "audio transcript"],
    "转写": ["transcript", "speech text"],
    "解说": ["narration", "voiceover", "speaker"],
    "旅行": ["travel photo", "tourist photo"],
    "毕业": ["graduation photo"],
    "宠物": ["pet"],
    "车辆": ["vehicle", "car"],
    "花": ["flower"],
}

#: Fixed values.
OBJECT_PROMPTS = {
    "狗": ["dog"],
    "猫": ["cat"],
    "公交车": ["bus"],
    "巴士": ["bus"],
    "汽车": ["car"],
    "车": ["car", "vehicle"],
    "摩托车": ["motorcycle"],
    "自行车": ["bicycle"],
    "飞机": ["airplane"],
    "火车": ["train"],
    "鸟": ["bird"],
    "动物": ["animal"],
    "马": ["horse"],
    "牛": ["cow"],
    "羊": ["sheep"],
    "披萨": ["pizza"],
    "三明治": ["sandwich"],
    "蛋糕": ["cake"],
    "香蕉": ["banana"],
    "苹果": ["apple"],
    "西兰花": ["broccoli"],
    "胡萝卜": ["carrot"],
    "人": ["person"],
    "孩子": ["child", "person"],
    "男人": ["man", "person"],
    "女人": ["woman", "person"],
    "方块": ["square", "block"],
    "球": ["ball"],
    "咖啡": ["coffee"],
    "水果": ["fruit"],
}

#: Fixed values.
TIME_PROMPTS = {
    "春天": ["spring"],
    "夏天": ["summer"],
    "秋天": ["autumn", "fall"],
    "冬天": ["winter", "cold weather"],
    "晚上": ["night"],
    "夜晚": ["night"],
}

#: Fixed values.
COLOUR_PROMPTS = {
    "红色": ["red"],
    "红": ["red"],
    "蓝色": ["blue"],
    "蓝": ["blue"],
    "绿色": ["green"],
    "绿": ["green"],
    "黄色": ["yellow"],
    "黄": ["yellow"],
    "白色": ["white"],
    "白": ["white"],
    "黑色": ["black"],
    "黑": ["black"],
}

#: Fixed values.
ACTION_PROMPTS = {
    "移动": ["moving"],
    "跑": ["running"],
    "行驶": ["driving"],
    "骑": ["riding"],
    "飞": ["flying"],
    "吃": ["eating"],
    "做饭": ["cooking"],
    "烹饪": ["cooking"],
    "走": ["walking"],
    "跳舞": ["dancing"],
}

#: Fixed values.
RELATION_MARKERS = {
    "左边": "left_of",
    "左侧": "left_of",
    "左": "left_of",
    "右边": "right_of",
    "右侧": "right_of",
    "右": "right_of",
    "上": "on",
    "上面": "on",
    "车上": "on",
    "下": "under",
    "下面": "under",
    "底": "under",
    "车底": "under",
    "里": "inside",
    "里面": "inside",
    "内": "inside",
    "旁边": "beside",
    "旁": "beside",
    "附近": "near",
    "后面": "behind",
    "前面": "in front of",
}

#: What a relation is set against.
CONTRASTS = {
    "on": ["under", "inside", "beside"],
    "under": ["on", "inside", "beside"],
    "left_of": ["right_of", "on", "under"],
    "right_of": ["left_of", "on", "under"],
    "inside": ["on", "under", "beside"],
    "beside": ["on", "under", "inside"],
    "near": ["on", "under", "inside"],
    "behind": ["in front of", "on", "beside"],
    "in front of": ["behind", "on", "beside"],
}
OTHER_CONTRASTS = ["on", "under", "inside", "beside"]

#: Words for kinds of media and for a search, seasons and their months.
VIDEO_WORDS = ("短视频", "视频", "片段")
IMAGE_WORDS = ("照片", "图片", "图像", "相片")
SEARCH_WORDS = ("找", "搜索", "检索", "查", "筛选", "照片", "图片", "素材", "合影")
ENGLISH_SEARCH_WORDS = ("search", "find", "photo", "image", "asset")
SEASON_MONTHS = {"春天": (3, 4, 5), "夏天": (6, 7, 8), "秋天": (9, 10, 11), "冬天": (12, 1, 2)}
YEARS_BACK = (("去年", 1), ("前年", 2), ("今年", 0))
QUERY_SEPARATORS = "_-，。、的在和与跟"

#: English words that Chinese ones add to a query.
TRANSLATIONS = {
    "蓝天": "blue sky",
    "天空": "sky",
    "海边": "beach seaside ocean",
    "大海": "ocean sea",
    "雪": "snow",
    "冬天": "winter snow",
    "夜景": "night city lights",
    "城市": "city street urban",
    "街道": "street city urban",
    "交通": "traffic vehicles city street",
    "建筑": "building architecture",
    "故宫": "Forbidden City palace Chinese traditional architecture",
    "合影": "group photo people portrait",
    "自拍": "selfie portrait person",
    "人像": "portrait person",
    "聚餐": "dinner restaurant food people",
    "食物": "food meal",
    "美食": "food meal",
    "做饭": "cooking food kitchen",
    "烹饪": "cooking food kitchen",
    "咖啡": "coffee drink cup",
    "水果": "fruit food",
    "猫": "cat",
    "狗": "dog",
    "鸟": "bird animal",
    "动物": "animal",
    "车": "car vehicle",
    "火车": "train railway",
    "篮球": "basketball sports ball",
    "足球": "football soccer sports ball",
    "跳舞": "dance people dancing",
    "访谈": "interview talk conversation guest speaker",
    "采访": "interview journalism reporter guest",
    "对话": "conversation interview talk",
    "演讲": "lecture presentation talk speaker",
    "讲座": "lecture presentation education speaker",
    "汇报": "presentation slides conference talk",
    "会议": "conference meeting presentation discussion",
    "字幕": "subtitle caption text speech",
    "语音": "speech audio transcript asr",
    "转写": "transcript speech text asr",
    "解说": "narrator narration speech",
    "花": "flower",
    "山": "mountain",
    "瀑布": "waterfall nature water",
    "海浪": "ocean waves sea",
    "湖": "lake water",
    "小孩": "child kid",
    "宝宝": "baby child",
    "运动": "sports running",
}

#: Terms that a term adds.
ALIASES = {
    "people": "people person",
    "group": "people person",
    "food": "apple banana broccoli cake carrot orange pizza sandwich",
    "cooking": "cook food",
    "coffee": "drink food",
    "fruit": "food",
    "vehicle": "bicycle bus car motorcycle train truck",
    "traffic": "bus car truck vehicle",
    "pet": "cat dog",
    "animal": "bird cat dog",
    "nature": "landscape mountain ocean waterfall",
    "waterfall": "nature",
    "ocean": "nature sea waves",
    "sports": "basketball football running",
    "basketball": "ball sports",
    "dance": "people person",
    "interview": "conversation guest speaker talk",
    "presentation": "conference lecture slides speaker talk",
    "lecture": "presentation speaker talk",
    "subtitle": "asr caption text",
    "caption": "subtitle text",
    "conference": "meeting presentation talk",
    "meeting": "conference talk",
    "journalism": "interview story",
}
NO_TERMS = ("photo", "picture", "image", "a", "the", "of", "at", "in", "on")
