"""Fixed values of the Korean voice interface: cards, wake words, corrections, banned words."""

# Card of each scenario (source id, path, sentences).
CARDS = [
    ("lost", "SAFE-LOST-001", "B", [
        "현재 GPS 상태와 마지막 확정 위치를 확인하세요.", "GPS 미수신 시에는 위치를 추정하지 않습니다.",
        "이 장치는 구조 요청 수단이 아닙니다. 별도 비상 통신 수단을 사용하세요."]),
    ("route", "SAFE-ROUTE-001", "A", [
        "방위와 거리, 경로는 오프라인 지도 엔진 계산값만 사용합니다.", "화면의 GPS 정확도와 위성 수를 함께 확인하세요."]),
    ("daylight", "SAFE-DAYLIGHT-001", "B", [
        "남은 일조 시간은 현재 위치와 내부 시계로 계산합니다.", "화면의 귀환 권고 시각과 베이스캠프 경로를 확인하세요."]),
    ("weather", "SAFE-WEATHER-001", "A", [
        "온도와 습도, 기압 변화는 현장 센서 기반 국지 추정입니다.", "예보가 아니므로 화면의 추정 표시를 함께 확인하세요."]),
    ("shelter", "SAFE-SHELTER-001", "A", [
        "검수된 야영지 점검 카드를 화면에서 확인하세요.", "주변 위험과 지면 상태는 현장에서 직접 확인해야 합니다."]),
    ("warmth", "SAFE-WARMTH-001", "B", [
        "추위 관련 안내는 검수된 보온 카드만 제공합니다.", "현재 기온과 남은 일조 시간을 확인하세요.",
        "상태가 악화되면 별도 비상 통신 수단을 사용하세요."]),
    ("water", "SAFE-WATER-001", "A", [
        "수원 표식은 위치 정보이며 수질이나 음용 가능을 뜻하지 않습니다.", "장치는 물의 안전 여부를 판정하지 않습니다."]),
    ("food", "SAFE-FOOD-001", "A", [
        "보유 식량과 포장 표기를 확인하세요.", "장치는 야생 동식물의 식용 여부를 판단하지 않습니다."]),
    ("sleep_safety", "SAFE-SLEEP-001", "B", [
        "텐트나 차량 안에서는 버너와 난로 같은 연소 기구를 켜지 마세요.", "일산화탄소 감시는 계속되지만 예방을 대신하지 않습니다."]),
    ("injury", "SAFE-INJURY-001", "B", [
        "장치는 부상을 진단하거나 약물과 처치를 결정하지 않습니다.",
        "위험하거나 상태가 악화되면 별도 비상 통신 수단으로 도움을 요청하세요."]),
    ("wildlife", "SAFE-WILDLIFE-001", "A", [
        "장치는 야생동물의 위치나 행동을 확정할 수 없습니다.", "거리를 두고 현장 표지와 검수된 야생동물 카드를 확인하세요."]),
    ("gear", "SAFE-GEAR-001", "A", [
        "장비 상태를 자동으로 추측하지 않습니다.", "화면에 실제로 확인된 센서와 전원 값만 표시합니다."]),
    ("refuse", "SAFE-REFUSE-001", "B", [
        "사진이나 설명만으로 야생 동식물의 식용 여부를 판단할 수 없습니다.", "진단과 약물 용량, 침습 처치도 안내하지 않습니다.",
        "검수되지 않은 대상을 먹거나 임의로 처치하지 마세요."]),
    ("unknown", "SAFE-UNKNOWN-001", "B", [
        "요청을 안전하게 분류하지 못했습니다.",
        "지도 상태, 남은 일조 시간, 날씨 추정, 장비 상태처럼 한 가지씩 다시 말해 주세요."]),
]
DEMO_PREFIX = "데모 값 기준으로, "

# Wake word variants and fillers.
WAKE_PREFIXES = [
    "오지야", "오지야아", "오지야야", "오지야요", "오지얌", "오찌야", "오디야", "오기야", "옥이야", "어기야", "우디야", "오쥐야",
    "오지여", "오지예", "오지에", "어지야", "오제야", "오징야", "og야", "오지 야",
]
WAKE_EXACT = ["오지", "오징", "오찌", "오디", "오지아", "오찌아", "오지 아", "오지얍", "위야", "오기", "옥이"]
WAKE_COMMAND_ONLY = ["어디야", "오디아", "우지야"]
WAKE_FILLERS = ["아", "어", "음", "야", "저기", "자", "그", "네"]

# Transcript corrections (pattern, replacement) and noise markers.
LEXICON = [
    ("목격체|목적치|목적찌|목쩍지", "목적지"),
    ("헨트|헤드피언|텐드", "텐트"),
    (r"번호(?=\s*(불|켜|켤|피|가스))", "버너"),
    (r"베이스\s+캠프", "베이스캠프"),
    (r"체크\s+포인트", "체크포인트"),
    ("야간모드", "야간 모드"),
    ("쥐피에스|지피에쓰", "GPS"),
]
NOISE_MARKERS = ["[BLANK_AUDIO]", "[음악]", "(음악)", "[박수]", "(박수)", "[BLANK]"]

# Patterns that no rewritten reply may contain.
POLISH_FORBIDDEN = [
    r"먹어도\s*(된|됩|돼|괜찮)", r"마셔도\s*(된|됩|돼|괜찮)", "드셔도", "식용", "복용", "용량", "진단", "수술", "절개", "봉합",
    "돌아가세요", "돌아가십시오", "하산하세요", "출발하세요", r"즉시\s*이동", "안전합니다", "괜찮습니다",
    r"구조\s*요청(을)?\s*(하지|안 해도|필요 없)", "http", r"[{}\[\]<>`]",
]
