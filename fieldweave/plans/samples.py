"""A dictionary over the test tables, and value-derived rows that grow with them."""

from __future__ import annotations

#: Fixed values: (table, table description, field, description, type).
SOURCE = [
    ("customer", "客户信息", "c_custkey", "客户编号", "BIGINT"),
    ("customer", "客户信息", "c_name", "客户名称", "VARCHAR"),
    ("customer", "客户信息", "c_nationkey", "国家编号", "INT"),
    ("customer", "客户信息", "c_acctbal", "账户余额", "DOUBLE"),
    ("customer", "客户信息", "c_mktsegment", "市场分类", "VARCHAR"),
    ("orders", "订单信息", "o_orderkey", "订单编号", "BIGINT"),
    ("orders", "订单信息", "o_custkey", "客户编号", "BIGINT"),
    ("orders", "订单信息", "o_orderstatus", "订单状态", "VARCHAR"),
    ("orders", "订单信息", "o_totalprice", "总价格", "DOUBLE"),
    ("orders", "订单信息", "o_orderdate", "订单日期", "TIMESTAMP"),
    ("orders", "订单信息", "o_orderpriority", "优先级", "VARCHAR"),
    ("part", "零件信息", "p_partkey", "零件编号", "BIGINT"),
    ("part", "零件信息", "p_name", "零件名称", "VARCHAR"),
    ("part", "零件信息", "p_type", "零件类型", "VARCHAR"),
    ("part", "零件信息", "p_size", "尺寸", "INT"),
    ("part", "零件信息", "p_retailprice", "零售价格", "DOUBLE"),
]
TARGET = [
    ("supplier", "供应商信息", "s_suppkey", "供应商编号", "BIGINT"),
    ("supplier", "供应商信息", "s_name", "供应商名称", "VARCHAR"),
    ("supplier", "供应商信息", "s_nationkey", "国家编号", "INT"),
    ("supplier", "供应商信息", "s_acctbal", "账户余额", "DOUBLE"),
    ("lineitem", "订单明细", "l_orderkey", "订单编号", "BIGINT"),
    ("lineitem", "订单明细", "l_partkey", "零件编号", "BIGINT"),
    ("lineitem", "订单明细", "l_suppkey", "供应商编号", "BIGINT"),
    ("lineitem", "订单明细", "l_quantity", "数量", "DOUBLE"),
    ("lineitem", "订单明细", "l_extendedprice", "总价格", "DOUBLE"),
    ("lineitem", "订单明细", "l_linestatus", "行状态", "VARCHAR"),
    ("lineitem", "订单明细", "l_shipdate", "发货日期", "TIMESTAMP"),
    ("nation", "国家信息", "n_nationkey", "国家编号", "INT"),
    ("nation", "国家信息", "n_name", "国家名称", "VARCHAR"),
    ("events", "事件流", "event_type", "事件类型", "VARCHAR"),
    ("events", "事件流", "ts", "事件时间", "TIMESTAMP"),
]
#: Readings of the Han characters above.
READINGS = {
    "客": "ke", "户": "hu", "信": "xin", "息": "xi", "编": "bian", "号": "hao", "名": "ming", "称": "cheng", "国": "guo", "家": "jia",
    "账": "zhang", "余": "yu", "额": "e", "市": "shi", "场": "chang", "分": "fen", "类": "lei", "订": "ding", "单": "dan", "状": "zhuang",
    "态": "tai", "总": "zong", "价": "jia", "格": "ge", "日": "ri", "期": "qi", "优": "you", "先": "xian", "级": "ji", "零": "ling",
    "件": "jian", "型": "xing", "尺": "chi", "寸": "cun", "售": "shou", "供": "gong", "应": "ying", "商": "shang", "明": "ming", "细": "xi",
    "数": "shu", "量": "liang", "行": "xing", "发": "fa", "货": "huo", "事": "shi", "流": "liu", "时": "shi", "间": "jian",
}
