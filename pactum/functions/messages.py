"""What findings say: templates with number formats, filled from the typed captures that stand beside a finding."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.functions import patterns as P

# Reason and suggestion of each rule. {value} is the number that the clause states, {hourly} what a monthly
# sum makes an hour; names in capitals are the limits of the rules; a comma after the colon groups thousands.
RULE_MESSAGES = {
    "penalty": ("퇴사·계약 불이행을 이유로 위약금이나 사전에 정한 손해배상액을 물리는 약정입니다. 근로기준법상 체결 자체가 금지됩니다.", "해당 조항을 삭제하고, 실제 발생한 손해가 있을 때 개별적으로 청구하도록 바꾸십시오."),
    "min_wage": ("명시된 시급 {value:,}원은 {MIN_WAGE_HOURLY:,}원 미만입니다. 미달 부분은 무효이며 최저임금액으로 지급한 것으로 봅니다.", "시급을 {MIN_WAGE_HOURLY:,}원 이상으로 정정하십시오."),
    "min_wage_monthly": ("월 급여 {value:,}원은 월 소정근로시간 {MONTHLY_HOURS}시간 기준 시급 약 {hourly:,}원으로, 최저임금 {MIN_WAGE_HOURLY:,}원에 미달합니다.", "월 급여를 {MIN_WAGE_MONTHLY:,}원 이상으로 정정하십시오."),
    "forced_labor": ("근로자의 퇴사 자체를 금지하거나 회사 승인에 종속시키는 조항입니다. 자유의사에 어긋나는 근로 강요에 해당할 수 있습니다.", "사직 의사표시 후 일정 기간(통상 30일) 인수인계 협조 의무로 바꾸십시오."),
    "leave_timing": ("연차 일수는 충족하지만 사용 시기를 회사가 일방적으로 지정하는 조항입니다. 연차는 근로자가 청구한 시기에 주는 것이 원칙입니다.", "근로자가 청구한 시기에 부여하되, 사업 운영에 막대한 지장이 있는 경우에만 시기를 변경할 수 있다고 수정하십시오."),
    "probation": ("수습기간을 {value}개월로 정하고 있습니다. 최저임금 감액이 허용되는 범위는 {PROBATION_MONTHS}개월 이내이므로 그 이후 감액 지급은 최저임금 위반이 됩니다.", "수습기간을 {PROBATION_MONTHS}개월 이내로 줄이거나, 이후 기간은 감액 없이 전액 지급으로 명시하십시오."),
    "annual_leave": ("연차를 {value}일로 정하고 있습니다. 1년간 80% 이상 출근 시 {LEAVE_DAYS}일이 법정 기준입니다.", "연차 유급휴가를 {LEAVE_DAYS}일 이상으로 수정하십시오."),
    "daily_hours": ("1일 소정근로시간을 {value}시간으로 정하고 있습니다. 휴게시간을 제외한 1일 근로시간은 {DAILY_HOURS}시간을 넘길 수 없습니다.", "소정근로시간을 1일 {DAILY_HOURS}시간으로 하고 초과분은 연장근로로 구분해 가산수당을 명시하십시오."),
    "weekly_hours": ("1주 소정근로시간을 {value}시간으로 정하고 있습니다. 법정 한도는 {WEEKLY_HOURS}시간입니다.", "1주 {WEEKLY_HOURS}시간으로 정정하십시오."),
    "unpaid_overtime": ("연장·야간·휴일 근로에 대한 가산수당을 지급하지 않는다는 취지입니다. 가산수당은 당사자 합의로 배제할 수 없습니다.", "연장·야간·휴일 근로 시 통상임금의 50% 이상을 가산 지급한다고 명시하십시오."),
    "dismissal_notice": ("해고 예고기간을 {value}일로 정하고 있습니다. 법정 기준은 {NOTICE_DAYS}일 전 예고 또는 그에 상당하는 통상임금 지급입니다.", "{NOTICE_DAYS}일 전 예고 또는 {NOTICE_DAYS}일분 통상임금 지급으로 수정하십시오."),
    "dismissal_at_will": ("정당한 이유 없이 해고할 수 있다는 취지의 조항입니다.", "해고 사유와 절차를 구체적으로 열거하고 정당한 이유를 요건으로 명시하십시오."),
    "settlement": ("퇴직 후 금품 청산 기한을 {value}일로 정하고 있습니다. 법정 기한은 {SETTLEMENT_DAYS}일 이내입니다.", "{SETTLEMENT_DAYS}일 이내 지급으로 수정하십시오."),
    "severance_waiver": ("퇴직금을 미리 나누어 지급하거나 포기하게 하는 조항입니다. 이런 약정은 퇴직금 지급으로 인정되지 않습니다.", "퇴직 시 계속근로기간 1년당 30일분 이상의 평균임금을 지급한다고 명시하십시오."),
    "marriage_pregnancy": ("혼인·임신·출산을 퇴직 사유로 예정하는 조항입니다.", "해당 조항을 전면 삭제하십시오."),
    "wage_offset": ("임금에서 대여금 등을 임의로 공제하는 조항입니다. 임금은 전액 지급이 원칙입니다.", "공제 항목은 법령에 근거가 있는 경우로 한정한다고 명시하십시오."),
    "break_time": ("휴게시간을 주지 않는다는 취지의 조항입니다.", "4시간 근로 시 30분 이상, 8시간 근로 시 1시간 이상의 휴게시간을 명시하십시오."),
    "dismissal_written": ("해고 사유와 시기를 서면으로 통지하지 않겠다는 취지의 조항입니다. 서면통지 없는 해고는 효력이 없습니다.", "해고 시 사유와 시기를 서면으로 통지한다고 명시하십시오."),
    "pay_cut": ("감급 제재를 임금의 {value}퍼센트로 정하고 있습니다. 감급 총액은 1임금지급기 임금 총액의 10분의 1을 넘을 수 없습니다.", "감급 한도를 임금 총액의 10분의 1 이내로 수정하십시오."),
    "fixed_term": ("기간제 계약기간을 {value}년으로 정하고 있습니다. 총 2년을 초과해 사용하면 기간의 정함이 없는 근로계약으로 전환된 것으로 봅니다.", "계약기간을 2년 이내로 하거나, 2년 초과 시 무기계약 전환을 명시하십시오."),
    "fixed_term_renewal": ("반복 갱신으로 2년을 넘겨도 무기계약으로 전환되지 않는다는 취지의 조항입니다. 법정 전환 효과는 약정으로 배제할 수 없습니다.", "해당 조항을 삭제하십시오."),
    "retaliation": ("법 위반 사실을 감독기관에 신고한 것을 이유로 불이익을 주는 조항입니다. 보복 조치는 금지되어 있습니다.", "해당 조항을 삭제하십시오."),
    "parental_leave": ("육아휴직을 허용하지 않거나 이를 이유로 불이익을 주는 조항입니다.", "육아휴직을 법령에 따라 허용하고, 복귀 시 같은 업무 또는 같은 수준의 임금 직무로 복직시킨다고 명시하십시오."),
    "rules_change": ("취업규칙을 근로자 동의 없이 변경할 수 있게 한 조항입니다. 불리한 변경에는 근로자 과반수의 동의가 필요합니다.", "불리한 변경 시 근로자 과반수의 동의를 받는다고 명시하십시오."),
    "discrimination": ("국적·신앙 또는 사회적 신분을 이유로 근로조건을 달리 정하는 조항입니다.", "해당 차별 기준을 삭제하고 직무 기준으로 대체하십시오."),
    "harassment": ("직장 내 괴롭힘을 문제 삼지 못하게 하거나 신고를 막는 조항입니다. 괴롭힘 금지는 법으로 정해져 있어 약정으로 배제할 수 없습니다.", "해당 조항을 삭제하고, 괴롭힘 발생 시 조사·조치 절차를 명시하십시오."),
    "maternity_leave": ("출산전후휴가를 주지 않거나 법정 기준(90일)보다 짧게 정한 조항입니다.", "출산 전후를 통하여 90일 이상의 출산전후휴가를 부여한다고 명시하십시오."),
    "spouse_leave": ("배우자 출산전후휴가를 주지 않거나 이를 이유로 불이익을 주는 조항입니다. 법정 휴가는 20일 유급입니다.", "배우자 출산전후휴가 20일을 유급으로 부여한다고 명시하십시오."),
    "job_interference": ("퇴직자의 재취업을 방해할 목적으로 명단을 작성하거나 통보하는 조항입니다.", "해당 조항을 전면 삭제하십시오."),
}
#: What these rules say of a clause that states no number.
PLAIN_MESSAGES = {
    "annual_leave": ("연차 유급휴가를 주지 않는다는 취지의 조항입니다.", "연차 유급휴가 규정을 근로기준법 기준으로 명시하십시오."),
    "pay_cut": ("감급 제재의 한도를 두지 않은 조항입니다. 법정 한도를 넘는 감급은 무효입니다.", "1회 평균임금 1일분의 2분의 1, 총액은 임금 총액의 10분의 1 이내로 명시하십시오."),
}
MISSING_MESSAGE = ("근로기준법 제17조가 서면 명시를 요구하는 항목 중 {missing}에 관한 내용을 찾지 못했습니다.", "빠진 항목을 계약서에 적어 넣고 서면으로 교부받으세요. 명시하지 않으면 사용자에게 500만원 이하의 벌금이 부과될 수 있습니다.")
UNSURE = "이 조항은 아래 조문에 저촉될 소지가 있어 확인이 필요합니다. "
SURENESS = "{reason} (분류기 확신도 {percent}%)"
REVIEW_HEAD = "# 근로계약서 검토 의견서\n\n아래는 원문 조항과, 법령에 저촉될 소지가 있는 부분에 대한 수정 제안입니다.\n원문은 그대로 두었습니다. 협상 자료로 사용하십시오.\n\n---\n\n"
REVIEW_FOOT = "---\n\n이 문서는 법률 자문이 아닙니다. 실제 분쟁이나 계약 체결 판단은\n노무사·변호사 또는 고용노동부 상담(☎1350)을 통해 확인하십시오."
REVIEW_WHY, REVIEW_LAW, REVIEW_FIX = "**문제** — ", "**근거** — ", "**수정 제안** — "


def pieces(template: str) -> list[tuple[str, str | None, str]]:
    """(text, field, format) of a template; limits of the rules are put into the text, other fields are left."""
    out, text = [], ""
    for before, field, form, _ in Formatter().parse(template):
        text += before
        if field is not None and hasattr(P, field):
            text += format(getattr(P, field), form)
        elif field is not None:
            out.append((text, field, form))
            text = ""
    return out + ([(text, None, "")] if text or not out else [])


def fill(template: str, fields: dict[str, Column]) -> Column:
    """The template with its fields: as they are, or with thousands grouped for a format of a comma. Null if one of them is."""
    shown = lambda c, form: F.format_number(c, 0) if form == "," else c.cast("string")
    parts = [c for text, field, form in pieces(template) for c in ([F.lit(text)] + ([shown(fields[field], form)] if field else []))]
    return F.concat(*parts)


def rule_message(rule: Column, value: Column, which: int) -> Column:
    """Reason (0) or suggestion (1) of a rule's finding by the rule's name and the number captured; null for other names."""
    fields = {"value": value, "hourly": F.round(value / P.MONTHLY_HOURS).cast("bigint")}
    said = []
    for name, texts in RULE_MESSAGES.items():
        one = fill(texts[which], fields)
        if name in PLAIN_MESSAGES:
            one = F.when(value.isNull(), fill(PLAIN_MESSAGES[name][which], fields)).otherwise(one)
        said.append(F.when(rule == name, one))
    return F.coalesce(*said)
