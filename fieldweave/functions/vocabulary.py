"""Word groups, patterns and type groups of the scoring rules, in order."""

BASE_WEIGHTS = (0.4, 0.5, 0.1)
ENHANCED_WEIGHTS = (0.3, 0.6, 0.1)
PINYIN_BOOST = 1.5

BASE_KEYWORDS = {
    "id": ["编号", "号码", "代码", "标识", "key"],
    "name": ["名称", "名字", "姓名"],
    "code": ["代码", "编码", "编号"],
    "type": ["类型", "种类", "分类"],
    "status": ["状态", "状况", "情况"],
    "time": ["时间", "日期", "date", "日", "年月日"],
    "date": ["日期", "时间", "time", "日", "年月日"],
    "desc": ["描述", "说明", "备注", "注释", "注解"],
    "amount": ["金额", "数量", "数目", "金钱", "价格", "价值"],
    "address": ["地址", "住址", "位置", "地点"],
    "phone": ["电话", "手机", "联系方式", "电话号码", "联系电话"],
}
BASE_TYPES = {
    "int": ["integer", "int", "bigint", "smallint", "tinyint", "number", "numeric", "整数", "数字"],
    "float": ["double", "decimal", "numeric", "real", "float", "浮点", "小数"],
    "char": ["varchar", "character", "nvarchar", "text", "string", "字符", "字符串"],
    "date": ["datetime", "timestamp", "time", "日期", "时间"],
    "bool": ["boolean", "bit", "布尔", "是否"],
}
BASE_PATTERNS = {
    r"id$|_id$": 0.8,
    r"^code|_code": 0.7,
    r"^name|_name": 0.7,
    r"^type|_type": 0.6,
    r"^date|_date|time|_time": 0.6,
    r"^desc|_desc|description|_description": 0.5,
    r"^status|_status": 0.6,
    r"^create|_create|^update|_update": 0.5,
}
SYNONYMS = {
    "id": ["编号", "号码", "代码", "标识", "key", "code", "identifier", "主键"],
    "name": ["名称", "名字", "姓名", "title", "label"],
    "code": ["代码", "编码", "编号", "代号", "id"],
    "type": ["类型", "种类", "分类", "category", "kind"],
    "status": ["状态", "状况", "情况", "condition", "state"],
    "time": ["时间", "日期", "date", "日", "年月日", "datetime", "timestamp"],
    "date": ["日期", "时间", "time", "日", "年月日", "datetime"],
    "desc": ["描述", "说明", "备注", "注释", "注解", "description", "remark"],
    "amount": ["金额", "数量", "数目", "金钱", "价格", "价值", "money", "price"],
    "address": ["地址", "住址", "位置", "地点", "location"],
    "phone": ["电话", "手机", "联系方式", "电话号码", "联系电话", "mobile"],
    "user": ["用户", "使用者", "人员", "person", "people"],
    "student": ["学生", "学员", "pupil", "learner"],
    "teacher": ["老师", "教师", "instructor", "educator"],
    "course": ["课程", "科目", "subject", "lesson"],
    "grade": ["成绩", "分数", "score", "mark"],
    "class": ["班级", "班", "class", "grade"],
    "school": ["学校", "院校", "institution"],
    "department": ["部门", "科室", "dept", "division"],
    "create": ["创建", "新建", "添加", "insert", "add"],
    "update": ["更新", "修改", "编辑", "modify", "edit"],
    "delete": ["删除", "移除", "remove"],
    "login": ["登录", "登入", "signin"],
    "logout": ["登出", "退出", "signout"],
}
ABBREVIATIONS = {
    "id": ["identifier", "identification"],
    "num": ["number"],
    "addr": ["address"],
    "tel": ["telephone"],
    "dept": ["department"],
    "mgr": ["manager"],
    "admin": ["administrator"],
    "info": ["information"],
    "desc": ["description"],
    "std": ["student"],
    "tch": ["teacher"],
    "cls": ["class"],
    "crs": ["course"],
    "sch": ["school"],
}
CONCEPTS = {
    "person_info": ["姓名", "name", "人员", "用户", "学生", "老师", "员工"],
    "identifier": ["编号", "id", "code", "标识", "主键", "key"],
    "temporal": ["时间", "日期", "time", "date", "创建", "更新"],
    "contact": ["电话", "手机", "邮箱", "地址", "联系"],
    "academic": ["成绩", "分数", "课程", "班级", "学校", "专业"],
    "status": ["状态", "状况", "类型", "种类", "标志"],
    "description": ["描述", "说明", "备注", "注释", "详情"],
}
ENHANCED_TYPES = {
    "integer": ["int", "integer", "bigint", "smallint", "tinyint", "number", "numeric", "整数", "数字"],
    "float": ["double", "decimal", "numeric", "real", "float", "money", "浮点", "小数", "金额"],
    "string": ["varchar", "char", "character", "nvarchar", "text", "string", "字符", "字符串", "文本"],
    "datetime": ["datetime", "timestamp", "time", "date", "日期", "时间"],
    "boolean": ["boolean", "bit", "bool", "布尔", "是否"],
    "binary": ["blob", "binary", "image", "二进制"],
}
ENHANCED_PATTERNS = {
    r"(id|_id|编号)$": 0.9,
    r"^(code|编码|代码)": 0.8,
    r"^(name|名称|姓名)": 0.8,
    r"(type|类型|种类)": 0.7,
    r"(date|time|时间|日期)": 0.7,
    r"(desc|description|说明|描述)": 0.6,
    r"(status|状态|状况)": 0.7,
    r"(create|add|新增|创建)": 0.6,
    r"(update|modify|更新|修改)": 0.6,
    r"(num|number|数量|序号)": 0.6,
}
ROBUST_CONCEPTS = {
    "id": ["id", "编号", "号码", "代码"],
    "name": ["name", "名称", "姓名", "名字"],
    "time": ["time", "日期", "时间", "date"],
    "code": ["code", "编码", "代码", "编号"],
    "type": ["type", "类型", "种类"],
    "status": ["status", "状态", "情况"],
}
ULTRA_CONCEPTS = {
    "id": ["id", "编号", "号码", "代码"],
    "name": ["name", "名称", "姓名", "名字"],
    "time": ["time", "日期", "时间", "date"],
    "create": ["create", "创建", "新建"],
    "update": ["update", "更新", "修改"],
}
