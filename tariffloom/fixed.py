"""Fixed values of the tariff domain.

Everything in this module is data that results depend on: names of sheets, anchors and
columns, word lists, code tables, text patterns and message texts.  It holds no logic.
"""

# --- fixed values: reference sheets ---------------------------------------------------
SHEETS = ("인정조사", "산정특례", "종합조사")

BASE_PRICE = "기본단가"
A_VALUE = "A값"
BASIC_RATE = "기본 부담률"
CAP_LABEL = "상한액"
GRADE_HEADER = "활동지원등급"
INCOME_HEADER = "기준중위소득"
DAY_BASIC = "주간활동 기본형"
DAY_EXTENDED = "주간활동 확장형"
SCALAR_ANCHORS = (
    BASE_PRICE, A_VALUE, BASIC_RATE, CAP_LABEL,
    GRADE_HEADER, INCOME_HEADER, DAY_BASIC, DAY_EXTENDED,
)
IGNORED_LABELS = ("면제", "-", "해당없음", "비고")

GRADES = tuple(f"{n}등급" for n in range(1, 5))
ZONE_HEADERS = tuple(f"{n}등급" for n in range(1, 16))
ZONES = tuple(f"{n}구간" for n in range(1, 16))
LETTERS = ("가", "나", "다", "라", "마", "바")
RATED_LETTERS = ("다", "라", "마", "바")
VARIANTS = ("기본형", "확장형")
FIXED_BASIC_RATE = {"가": 0, "나": 20000}
FIXED_ADD_RATE = {"가": 0, "나": 0}
ADD_ITEMS = (
    "최중증1인가구", "1등급1인가구", "2등급이하1인가구",
    "최중증취약가구", "1등급취약가구", "2등급이하취약가구",
    "출산", "자립준비", "학교생활", "직장생활",
    "보호자일시부재", "나머지가구구성원의직장생활등",
)

# --- fixed values: keys of extracted constants ----------------------------------------
K_IJ_CAP = "인정조사 본인부담금 상한액"
K_SJ_CAP = "종합조사/산정특례 본인부담금 상한액"
K_IJ_RATES = "인정조사 본인부담률 (기본급여)"
K_ADD_RATES = "인정조사 본인부담률 (추가급여)"
K_SJ_RATES = "종합조사/산정특례 본인부담률"
K_IJ_LIMITS = "인정조사 월한도액"      # followed by " (variant)"
K_JH_LIMITS = "종합조사 월한도액"      # followed by " (variant)"
K_ADD_LIMITS = "추가급여 월한도액"
K_YEAR = "사업년도"
K_CHASU = "차수"
SYNC_KEYS = (BASE_PRICE, A_VALUE)
SPECIAL_CASE_KEYS = (
    BASE_PRICE, K_SJ_CAP, K_SJ_RATES, f"{K_IJ_LIMITS} (기본형)", K_ADD_LIMITS,
)
GROUP_SIZES = {
    K_IJ_RATES: 6, K_ADD_RATES: 6, K_SJ_RATES: 6,
    f"{K_IJ_LIMITS} (기본형)": 4, f"{K_IJ_LIMITS} (확장형)": 4,
    f"{K_JH_LIMITS} (기본형)": 15, f"{K_JH_LIMITS} (확장형)": 15,
    K_ADD_LIMITS: 12,
}

# --- fixed values: labels a sheet must contain (label, sheet, value, tables, exact) ----
TABLE_BASIC = "기본급여 단가표"
TABLE_ADD = "추가급여 단가표"
REQUIRED_LABELS = (
    (BASE_PRICE, "인정조사", "기본단가", (TABLE_BASIC,), False),
    (A_VALUE, "인정조사", "인정조사 본인부담금 상한액", (TABLE_BASIC,), False),
    (BASIC_RATE, "인정조사", "인정조사 본인부담률", (TABLE_BASIC, TABLE_ADD), False),
    (GRADE_HEADER, "인정조사", "인정조사 월한도액", (TABLE_BASIC,), False),
    (CAP_LABEL, "산정특례", "종합조사·산정특례 본인부담금 상한액", (TABLE_BASIC,), False),
    (INCOME_HEADER, "산정특례", "종합조사·산정특례 본인부담률", (TABLE_BASIC,), False),
    (DAY_BASIC, "종합조사", "종합조사 월한도액 (기본형)", (TABLE_BASIC,), False),
    (DAY_EXTENDED, "종합조사", "종합조사 월한도액 (확장형)", (TABLE_BASIC,), False),
    *((g, "인정조사", "인정조사 월한도액의 등급 행", (TABLE_BASIC,), True) for g in GRADES),
    *((z, "종합조사", "종합조사 월한도액의 구간 열", (TABLE_BASIC,), True) for z in ZONE_HEADERS),
    *((a, "산정특례", "추가급여 월한도액의 항목 열", (TABLE_BASIC, TABLE_ADD), True) for a in ADD_ITEMS),
)

# --- fixed values: label text patterns and word lists ---------------------------------
UNIT_NOTE = r"[(\[]\s*(?:단위\s*[:：][^)\]]*|원|천원|백만원|pt|포인트|%|점|명|개|월|년)\s*[)\]]"
DECORATION = "[]「」『』【】〔〕<>"
KEY_PUNCTUATION = r"[\s()（）\[\]「」『』·・,.\-_/]"
BAND = r"^([0-9]+(?:\.[0-9]+)?)%(이하|이상|초과|미만)$"
ORDINAL = r"^([0-9]+)(등급|구간)$"
FORM = r"^(.*?)(기본형|확장형)$"
MONEY = r"([0-9,]{4,})원"
SEGMENT = r"([0-9]+)\s*구간"
GRADE = r"([0-9]+)\s*등급"
NUMBER_TOKEN = r"([0-9]+(?:\.[0-9]+)?)"
YEAR_TOKEN = r"^(?:19|20)[0-9]{2}$"
ANTONYMS = (
    ("이하", "초과"), ("이상", "미만"), ("기본형", "확장형"), ("가능", "불가능"),
    ("포함", "제외"), ("이전", "이후"), ("최소", "최대"), ("가산", "감산"),
)
NEGATIONS = ("아님", "않음", "없음", "미해당", "비해당")

# --- fixed values: similarity parameters ----------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
IDF_FLOOR = 0.01
ALPHA = 0.6
COSINE_FLOOR = 0.76
CUTOFF = 0.28
CONFLICT_FACTOR = 0.15
EXTRA_FACTOR = 0.6
LOW_MARGIN = 0.05
UNIT_SHIFT = 10

# --- fixed values: grade names ---------------------------------------------------------
SPECIAL_GRADES = ("긴급활동지원", "부적합")
GRADE_NAME = r"^(.+?)\(([가-힣])형\)(_주간확장)?$"
ADD_NAME = r"^(.+?)_([가-힣])형$"

# --- fixed values: generated tables ----------------------------------------------------
BASIC_COLUMNS = (
    "안", "사업유형ID", "사업년도", "차수", "등급구분", "등급명", "바우처구분", "지원량",
    "정부지원금", "본인부담금", "", "재판정여부", "재판정기간", "소득기준ID", "소득기준년도",
    "소득구분", "정렬순서", "물품코드",
)
ADD_COLUMNS = (
    "순번", "등급구분", "등급명", "지원량", "정부지원금", "본인부담금", "소득구분", "추가급여구분",
)
PAYMENT_COLUMNS = (
    "순번", "사업년도", "차수", "사업구분", "사업구분명", "사업유형ID", "사업유형명",
    "서비스유형ID", "서비스유형명", "서비스종류", "서비스종유명", "등급구분", "등급명",
    "서비스시간", "서비스시간명", "단위기준단가", "단위기준심야단가", "지원량", "정부지원금액",
    "본인부담금액", "정부지원금율", "본인부담금율", "사용여부", "서비스시작일자", "서비스종료일자",
    "단가관리레벨", "비고",
)
BUSINESS_ID = "HWG001"
VOUCHER = "포인트"
NO_REJUDGE = "불가능"
NO_INCOME = ":::선택:::"
BUSINESS = {
    "사업구분": "HW01", "사업구분명": "장애인활동지원",
    "사업유형ID": "HWG001", "사업유형명": "장애인활동지원",
}
EXCLUDED_GRADES = ("9999",)
IJ_INCOME = {
    "가": "기초수급자", "나": "차상위", "다": "전국가구평균소득50%이하",
    "라": "전국가구평균소득50%초과~100%이하", "마": "전국가구평균소득100%초과~150%이하",
    "바": "전국가구평균소득150%초과~200%이하",
}
JH_INCOME = {
    "가": "기초수급자", "나": "차상위", "다": "기준중위소득70%이하",
    "라": "기준중위소득70%초과~120%이하", "마": "기준중위소득120%초과~180%이하",
    "바": "기준중위소득180%초과",
}
# item: (first code, grade name, category text)
ADD_CODES = {
    "출산": (25, "출산가구", "출산가구여부"),
    "학교생활": (31, "학교생활", "학교생활여부"),
    "직장생활": (37, "직장생활", "직장생활여부"),
    "자립준비": (43, "자립준비", "자립준비여부"),
    "보호자일시부재": (61, "보호자일시부재", "보호자일시부재"),
    "나머지가구구성원의직장생활등": (67, "가족의직장생활", "가족의직장생활"),
    "최중증1인가구": (73, "최중증1인가구", "최중증1인가구여부"),
    "1등급1인가구": (79, "1등급1인가구", "1등급1인가구"),
    "2등급이하1인가구": (85, "2등급1인가구", "2등급이하1인가구"),
    "최중증취약가구": (91, "최중증취약가구", "최중증취약가구"),
    "1등급취약가구": (97, "1등급취약가구", "1등급취약가구"),
    "2등급이하취약가구": (103, "2등급취약가구", "2등급이하취약가구"),
}
# grade: main supplements of the special cases, in their numbering order
SPECIAL_CASES = (
    ("1등급", ("최중증취약가구", "최중증1인가구", "1등급취약가구", "1등급1인가구",
             "나머지가구구성원의직장생활등", None)),
    ("2등급", ("2등급이하취약가구", "2등급이하1인가구", None)),
    ("3등급", ("2등급이하취약가구", "2등급이하1인가구", None)),
    ("4등급", ("2등급이하취약가구", "2등급이하1인가구", None)),
)
SCHOOL_WORK = ((True, True), (True, False), (False, True), (False, False))
# first sort number of each block of the basic table
SORT_START = {
    ("ij", "기본형"): 1, ("jh", "기본형"): 25, ("ij", "확장형"): 241, ("jh", "확장형"): 265,
    ("sj", "기본형"): 361, ("sj", "확장형"): 1081,
}

# --- fixed values: services -------------------------------------------------------------
# price key, service type, service kind, minutes, day price factor source, night source
SERVICE_TYPE = {"활동보조": "ST0001", "방문간호": "ST0002", "방문목욕": "ST0003", "방문간호지시서": "ST0004"}
SERVICE_KIND = {
    "사회활동지원": "SK0001", "신체활동지원": "SK0002", "가사활동지원": "SK0003", "기타서비스": "SK0004",
    "기본간호": "SK0005", "치료간호": "SK0006", "교육상담": "SK0007",
    "차량내입욕": "SK0008", "가정내입욕": "SK0009",
    "의료기관 방문": "SK0010", "의료기관 의사내방": "SK0011",
    "보건기관 방문": "SK0012", "보건기관 의사내방": "SK0013",
}
HELP_KINDS = ("사회활동지원", "신체활동지원", "가사활동지원", "기타서비스")
NURSE_KINDS = ("기본간호", "치료간호", "교육상담")
NURSE_TIMES = {"30분미만": 0, "30분이상60분미만": 30, "60분이상": 60}
TIME_NAME = {0: "0분부터 30분미만", 30: "30분부터 60분미만", 40: "40분부터 59분까지", 60: "60분이상"}
SERVICE_COUNTS = {"ST0001": 8, "ST0002": 9, "ST0003": 4, "ST0004": 4}

# --- fixed values: notices ----------------------------------------------------------------
HWPX_NS = "{http://www.hancom.co.kr/hwpml/2011/paragraph}"
CHAPTER = r"^(제\s*[0-9]+\s*장|부\s*칙)"
ITEM = r"^[0-9]+\."
ITEM_MAX = 40
LABEL_MAX = 20
# service: (title, words inside the table)
NOTICE_TABLES = {
    "활동보조": ("활동보조", ("시간당",)),
    "방문목욕": ("방문목욕", ()),
    "방문간호": ("방문간호", ()),
    "방문간호지시서": ("방문간호지시서", ()),
    "월한도액": ("월 한도액", ("활동지원급여 구간", "종합점수")),
    "주간활동": ("월 한도액", ("주간활동 기본형",)),
    "인정조사기본급여": ("부 칙", ("활동지원등급", "기본급여")),
    "추가급여": ("부 칙", ("추가급여",)),
}
PRICE_SERVICES = ("활동보조", "방문목욕", "방문간호", "방문간호지시서")
# ordered: the first phrase found decides
ADD_PHRASES = (
    ("나머지", "나머지가구구성원의직장생활등"), ("일시적으로부재", "보호자일시부재"),
    ("자립", "자립준비"), ("학교에다니는", "학교생활"), ("직장에다니는", "직장생활"), ("출산", "출산"),
)
ADD_HOUSEHOLDS = (
    ("독거", ("최중증1인가구", "1등급1인가구", "2등급이하1인가구")),
    ("가구구성원", ("최중증취약가구", "1등급취약가구", "2등급이하취약가구")),
)
ADD_TIERS = (("400점이상", 0), ("380점미만", 2))
ORDER_WAYS = r"(대상자가.*?방문|의사가\s*가정을\s*방문)"
PRICE_ALIASES = {"활동보조.일반": "기본단가"}
REFERENCE_IGNORED = ("사업년도", "차수")
PRICE_MAX = 10_000_000

# --- fixed values: states -------------------------------------------------------------------
AGREE, DIFFER, ABSENT = "일치", "불일치", "조견표에 없음"
AUTO_PASS, NEEDS_REVIEW, UNMATCHED = "auto_pass", "needs_review", "unmatched"

# --- fixed values: message texts of findings --------------------------------------------------
MESSAGES = {
    "LIMIT_BASIC": "지원량이 조견표 월한도액과 다름",
    "LIMIT_ADD": "지원량이 추가급여 월한도액과 다름",
    "COPAY": "본인부담금 재계산 값과 다름",
    "SUM_GOV": "정부지원금이 맞지 않음 (지원량·본인부담금은 조견표와 일치)",
    "SUM_RIGHT": "정부지원금 + 본인부담금이 지원량과 맞지 않음"
                 " (지원량은 조견표와 일치하므로 오른쪽 두 값의 문제)",
    "SUM_ANY": "지원량 ≠ 정부지원금 + 본인부담금",
    "GRANULARITY": "본인부담금이 100원 단위가 아님",
    "CAP": "본인부담금이 상한액 {}원을 넘음",
    "EMERGENCY_LIMIT": "긴급활동지원 지원량이 종합조사 기본형 13구간 한도액과 다름",
    "EMERGENCY_COPAY": "긴급활동지원 본인부담금은 0이어야 함",
    "INELIGIBLE": "부적합 행의 금액은 모두 0이어야 함",
    "NAME": "등급명 형식을 해석할 수 없음",
    "ROW_COUNT": "행 개수가 예상과 다름 (예상 {} / 실제 {})",
    "TIER": "'{}' 그룹에 소득형이 빠짐: {}",
    "DUP_CODE": "등급구분 '{}' 중복 ({}행과 같음)",
    "DUP_NAME": "등급명 '{}' 중복 ({}행과 같음)",
    "DUP_ROW": "중복 행: {}행과 키가 같음",
    "NEED": "검증에 필요한 값이 없습니다: '{}'",
    "PAY_SUPPORT": "지원량이 기본급여 단가표({})와 다름",
    "PAY_GOV": "정부지원금액이 기본급여 단가표({})와 다름",
    "PAY_COPAY": "본인부담금액이 기본급여 단가표({})와 다름",
    "PAY_RATE": "{}이 기본급여 기준 계산값과 다름",
    "PAY_GRANULARITY": "본인부담금액이 100원 단위가 아님",
    "UNIT_DAY": "단위기준단가가 고시 기준 계산값과 다름",
    "UNIT_NIGHT": "단위기준심야단가가 고시 기준 계산값과 다름",
    "FIVE_COPAY_RATE": "본인부담금율이 틀림 (금액·정부지원금율은 서로 일치)",
    "FIVE_GOV_RATE": "정부지원금율이 틀림 (금액·본인부담금율은 서로 일치)",
    "FIVE_COPAY": "본인부담금액이 틀림 (지원량·정부지원금액·율과 대조)",
    "FIVE_GOV": "정부지원금액이 틀림 (지원량·본인부담금액·율과 대조)",
    "FIVE_SUPPORT": "지원량이 틀림 (금액 합·두 율과 대조)",
    "FIVE_SUM": "지원량 ≠ 정부지원금액 + 본인부담금액",
    "GOV_RATE_OFF": "정부지원금율이 금액과 다름",
    "COPAY_RATE_OFF": "본인부담금율이 금액과 다름",
}
