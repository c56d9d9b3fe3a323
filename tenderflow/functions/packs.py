"""Field packs: what to look for in a block for each field, best pattern first."""

from __future__ import annotations

from typing import NamedTuple

TAIL = r"(?=[，。;；\n]|地址|联系人|电话|邮编|传真|邮箱|备注|$)"
SHORT = r"(?=[，。;；\n]|$)"
VALUE = r"([^\n，。;；]{2,60}?)"
NUMBER = r"([A-Za-z0-9][A-Za-z0-9\-_/（）()\.、]{3,40}?)"
NUMERALS = "零〇一二两三四五六七八九壹贰叁肆伍陆柒捌玖拾佰仟万亿"
DAY = r"[^。\n\d]{0,10}((?:\d{4}|[零〇一二三四五六七八九]{4})\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日[^\n，。;；]{0,12})"
LIMIT = "最高投标限价|最高限价|招标控制价|拦标价"
ORGANISATION = "有限公司|集团|公司|企业|局|中心|医院|大学|研究院|研究所|人民政府|委员会"
FRONT = ("notice", "instructions_front")


class Pattern(NamedTuple):
    confidence: float
    regex: str


class Pack(NamedTuple):
    """words: one of them is in every text that a pattern fits; squeeze: OCR spaces go first."""

    kind: str
    words: str
    patterns: tuple[Pattern, ...]
    zones: tuple[str, ...] = FRONT
    squeeze: bool = False


def labelled(confidence: float, label: str, value: str = VALUE, tail: str = TAIL) -> Pattern:
    """`label：value` up to the end of the clause or the next label."""
    return Pattern(confidence, rf"(?:{label})\s*[：:]\s*{value}{tail}")


def up_to(n: int, least: int = 2) -> str:
    return rf"([^\n，。;；]{{{least},{n}}}?)"


# Keys, kinds, labels, patterns with their confidence, preferred zones. An amount keeps
# the unit that follows it.
PACKS = {
    "project_name": Pack("text", "项目|工程|标段名称", (
        labelled(0.95, "项目名称|工程名称|采购项目名称|标段名称"),
        Pattern(0.88, r"^([^\n：]{6,55}?(?:建设项目|工程|采购项目))\s*(?:施工|监理|设计|勘察|服务)?(?:招标|采购)\s*$"),
        Pattern(0.80, r"就\s*(?:以下)?\s*([一-龥（）A-Za-z0-9]+?)项目\s*(?:进行|施工|采购)"),
    ), ("notice", "instructions_front", "instructions")),
    "tender_no": Pack("number", "编号", (
        labelled(0.95, "招标编号|项目编号|招标项目编号", NUMBER),
        labelled(0.90, "标段编号|采购编号|招标文件编号", NUMBER),
        Pattern(0.85, r"[（(](?:招标编号|项目编号)[：:]?\s*([A-Za-z0-9][A-Za-z0-9\-_/]{3,30})\s*[）)]"),
    ), squeeze=True),
    "tenderer": Pack("org", r"招\s*标\s*人|采购人|建设单位", (
        Pattern(0.95, rf"招\s*标\s*人[：:]\s*([^\n，。;；]{{4,30}}(?:{ORGANISATION}))"),
        labelled(0.93, "采购人"),
        labelled(0.90, "建设单位"),
        labelled(0.85, r"招\s*标\s*人"),
    )),
    "agency": Pack("org", "招标代理|采购代理", (
        Pattern(0.95, r"招标代理机构[：:]\s*([^\n，。;；]{4,30}(?:有限公司|集团|公司))"),
        labelled(0.92, "采购代理机构"),
        labelled(0.88, "招标代理"),
    )),
    "legal_representative": Pack("person", "法定代表人|法人代表", (labelled(0.95, "法定代表人|法人代表"),)),
    "contact_phone": Pack("contact", "联系方式|电话|传真", (
        Pattern(0.95, r"(?:联系电话|联系方式)[：:]\s*((?:1[3-9]\d{9})|(?:0\d{2,3}-?\d{7,8}))"),
        labelled(0.85, "联系电话|电话|传真", r"([0-9\-—－至,，、]{7,25})"),
    )),
    "credit_code": Pack("credit", "统一社会信用代码", (
        labelled(0.95, "统一社会信用代码", "([0-9A-HJ-NPQRTUWXY]{18})"),
    ), (*FRONT, "qualification"), squeeze=True),
    "fund_source": Pack("text", "资金", (labelled(0.92, "资金来源|资金性质"),)),
    "site": Pack("text", "地点", (labelled(0.92, "建设地点|项目地点|工程地点|实施地点"),)),
    "price_limit": Pack("amount", "限价|控制价|拦标价|最高投标报价|预算", (
        Pattern(0.98, rf"(?:{LIMIT}|最高投标报价)[^\n（）()]{{0,12}}[（(]\s*([^（）()]{{4,50}})[）)]"),
        Pattern(0.95, rf"(?:{LIMIT})[：:]\s*(?:人民币)?\s*([{NUMERALS}]+(?:元[整]?)?)"),
        Pattern(0.93, rf"(?:{LIMIT})[：:]\s*(?:人民币)?\s*(\d[\d,，]*(?:\.\d+)?\s*万?元)"),
        Pattern(0.90, rf"(?:{LIMIT})[^\n\d]{{0,20}}[：:]?\s*[¥￥]?\s*(\d[\d,，]*(?:\.\d+)?(?:\s*万?元)?)"),
        Pattern(0.85, rf"(?:预算金额|采购预算)[：:]\s*(?:人民币)?\s*([{NUMERALS}\d,，.]+(?:万|亿)?元?)"),
    ), ("notice", "instructions_front", "instructions")),
    "budget_amount": Pack("amount", "预算", (
        Pattern(0.93, r"(?:预算金额|采购预算|项目预算)[^\n（）()]{0,8}[（(]\s*([^（）()]{4,40})[）)]"),
        labelled(0.90, "预算金额|采购预算|项目预算"),
    )),
    "security_deposit": Pack("amount", "保证金", (
        Pattern(0.95, r"(?:投标保证金|保证金金额)[^\n（）()]{0,8}[（(]\s*([^（）()]{2,40})[）)]"),
        Pattern(0.93, rf"投标保证金[：:]\s*(?:人民币)?\s*([{NUMERALS}\d,，.]+(?:万|亿)?元?)"),
        labelled(0.88, "保证金金额"),
        labelled(0.80, "保证金"),
    ), ("instructions_front", "instructions", "notice")),
    "bid_deadline": Pack("date", "截止时间|开标时间", (
        Pattern(0.95, rf"投标文件递交的?截止时间{DAY}"),
        Pattern(0.95, rf"投标截止时间{DAY}"),
        Pattern(0.90, rf"开标时间{DAY}"),
    ), ("instructions_front", "notice", "instructions"), squeeze=True),
    "bid_validity": Pack("duration", "投标有效期", (
        Pattern(0.95, r"投标有效期[^\d]{0,15}(\d{1,3}\s*(?:日历天|历天|工作日|天|日))"),
    ), ("instructions_front", "instructions"), squeeze=True),
    "duration": Pack("duration", "工期|服务期|实施周期|交货期|供货期", (
        Pattern(0.95, rf"计划工期[：:]\s*{up_to(25)}{SHORT}"),
        Pattern(0.93, rf"合同工期[：:]\s*{up_to(25)}{SHORT}"),
        Pattern(0.90, rf"工期要求[：:]\s*{up_to(25)}{SHORT}"),
        labelled(0.88, "服务期|实施周期|交货期|供货期"),
        labelled(0.85, "总?工期"),
    ), ("instructions_front", "notice", "instructions")),
    "quality_standard": Pack("text", "质量", (
        labelled(0.92, "质量标准|工程质量标准|质量要求", up_to(28), SHORT),
        Pattern(0.88, rf"质量要求\s*[：:]?\s*\n\s*{up_to(50, 4)}(?=[。;；\n]|$)"),
    ), ("instructions_front", "notice", "tech_requirements")),
    "performance_bond": Pack("amount", "履约保证金", (
        Pattern(0.93, r"履约保证金[^\n（）()]{0,8}[（(]\s*([^（）()]{2,30})[）)]"),
        labelled(0.90, "履约保证金"),
    ), ("instructions", "contract", "instructions_front")),
    "deposit_refund": Pack("text", "保证金退还|退还保证金|退保", (
        labelled(0.88, "保证金退还|退还保证金|退保", up_to(50), SHORT),
    ), ("instructions_front", "instructions")),
    "deposit_method": Pack("text", "缴纳方式|递交方式", (
        labelled(0.88, "保证金缴纳方式|缴纳方式|递交方式", up_to(40), SHORT),
    ), ("instructions_front", "instructions")),
    "payment_terms": Pack("text", "付款条件|付款方式|结算方式|支付方式", (
        labelled(0.88, "付款条件|付款方式|结算方式|支付方式", up_to(40), SHORT),
    ), ("instructions_front", "contract")),
    "objection_clause": Pack("text", "异议", (
        labelled(0.88, "异议与投诉|异议处理|提出异议", up_to(50), SHORT),
    ), ("instructions", "notice")),
    "doc_get_way": Pack("text", "招标文件", (
        labelled(0.88, "招标文件获取方式|获取招标文件方式|招标文件的?获取", up_to(50), SHORT),
    )),
    "doc_price": Pack("amount", "售价|工本费", (
        Pattern(0.93, r"(?:招标文件|文件)售价[^\n（）()]{0,6}[（(]\s*([^（）()]{1,20})[）)]"),
        labelled(0.90, "招标文件售价|文件售价|工本费"),
    )),
    "submission_location": Pack("text", "地点", (
        labelled(0.90, "投标文件递交地点|递交地点|投标文件提交地点|提交地点"),
    ), ("instructions_front", "notice", "instructions")),
    "warranty_period": Pack("duration", "质保期|保修期|质量保证期|缺陷责任期", (
        labelled(0.90, "质保期|保修期|质量保证期|缺陷责任期", up_to(20, 1), SHORT),
    ), ("instructions_front", "tech_requirements", "notice")),
    "acceptance_requirements": Pack("text", "验收", (
        labelled(0.88, "验收要求|验收标准", up_to(40), SHORT),
    ), ("instructions_front", "tech_requirements")),
    "evaluation_method": Pack("text", "评标办法|评审办法|评标方式", (
        labelled(0.92, "评标办法|评审办法|评标方式", up_to(30), SHORT),
    ), ("evaluation_method", "instructions_front")),
    "evaluation_committee": Pack("text", "评标委员会", (
        labelled(0.88, "评标委员会(?:的)?组成|评标委员会构成", up_to(50), SHORT),
    ), ("evaluation_method",)),
    "technical_weight": Pack("text", "技术", (
        Pattern(0.90, r"技术(?:标|部分)?[^\d%。]{0,8}(\d{1,3})\s*分"),
    ), ("evaluation_method", "scoring")),
    "commercial_weight": Pack("text", "商务", (
        Pattern(0.90, r"商务(?:标|部分)?[^\d%。]{0,8}(\d{1,3})\s*分"),
    ), ("evaluation_method", "scoring")),
    "price_weight": Pack("text", "价格|报价", (
        Pattern(0.90, r"(?:价格|报价)(?:标|部分)?[^\d%。]{0,8}(\d{1,3})\s*分"),
    ), ("evaluation_method", "scoring")),
}

# Cell labels of each field, and what a value cell is not.
LABELS = {
    "project_name": "(?:项目名称|工程名称|采购项目名称|标段名称)$",
    "tender_no": "(?:招标编号|项目编号|标段编号|采购编号)$",
    "tenderer": r"(?:招\s*标\s*人|采购人|建设单位)$",
    "agency": "(?:招标代理机构|采购代理机构|招标代理)$",
    "fund_source": "(?:资金来源|资金性质)$",
    "site": "(?:建设地点|项目地点|工程地点|实施地点)$",
    "price_limit": "(?:最高投标限价|最高限价|招标控制价|拦标价|预算金额)",
    "budget_amount": "(?:预算金额|采购预算)",
    "security_deposit": "(?:应?提交)?投标保证金(?:（?万元）?|金额)?$",
    "deposit_method": "(?:保证金缴纳方式|缴纳方式)$",
    "bid_deadline": "(?:投标截止时间|投标文件递交截止时间|递交投标文件截止时间|开标时间)$",
    "bid_validity": "投标有效期$",
    "duration": "(?:计划工期|合同工期|工期|服务期|交货期|供货期)$",
    "quality_standard": "(?:质量标准|质量要求)$",
    "evaluation_method": "(?:评标办法|评审办法)$",
    "credit_code": "统一社会信用代码$",
    "legal_representative": "(?:法定代表人|法人代表)$",
    "contact_phone": "(?:联系电话|联系方式|电话|传真)$",
    "warranty_period": "(?:质保期|保修期|质量保证期|缺陷责任期)$",
    "performance_bond": "履约保证金(?:（?万元）?)?$",
    "doc_price": "(?:招标文件售价|文件售价|工本费)$",
    "submission_location": "(?:投标文件递交地点|递交地点|提交地点)$",
}
COLUMN_HEAD = r"^(?:[^0-9]{1,10}?)?(?:名称|编号|规模|金额|时间|等级|数量|算法|系数|内容|类型)(?:\s*[（(].*)?$"
EMPTY_CELLS = ("", "—", "/", "无")
JUNK_LABELS = "^(?:招标编号|项目编号|标段编号|采购编号|分标编号|工程名称|分标|序号|条款|条款号)[：:]?$"
JUNK_VALUES = ("无", "见", "详见", "/", "前附表", "详见第五章", "详见下表", "详见附件")
REFERENCE = r"^\s*(?:详见?|见)[（(]?[^）)]*(?:公告|前附表|须知|章|附件|规范书|一览表)"
PERSON_HEADS = ("姓名", "名称", "本人", "签字", "日期", "备注")
AMOUNT_HEAD = "^(?:[¥￥]|[0-9一二两三四五六七八九壹贰叁肆伍陆柒捌玖拾佰仟万亿零]|人民币)"
AMOUNT_CHARACTERS = r"[\d一二两三四五六七八九壹贰叁肆伍陆柒捌玖拾佰仟万亿零元整角分圆人民币.,，。\s()（）¥￥/]"
DATE_ASIDES = "[（(]下同[）)]|[（(]即[^）)]*[）)]"
