"""Rule tables as data, and the few ways they are applied: first match, all matches, mask then confirm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.scalars import half_width, replaced_all, squeeze

# Category by the first pattern of a title that matches.
CATEGORIES = [
    ("説明会", "オープンキャンパス|Open.?Campus"),
    ("採用イベント", "採用試験|試験"),
    ("採用イベント", "キャリア|就職|お仕事セミナー|仕事体験|職業体験|ガールズトーク|女性向け|学園祭|大学祭|レンサルティング"),
    ("説明会", "説明会|ガイダンス|制度説明|募集案内|セミナー"),
    ("説明会", "募集"),
    ("説明会", "相談会|座談会"),
    ("地域参加", "交流会"),
    ("一般公開", "一般公開|基地公開|駐屯地公開|開放デー"),
    ("艦艇公開", "護衛艦|潜水艦|掃海艦|掃海艇|ミサイル艇|支援艦|補給艦|輸送艦|艦艇|乗艦"),
    ("体験", "体験搭乗|体験飛行|ヘリ体験|操縦体験|操縦教育"),
    ("体験", "見学|体験|FAMILY|ファミリー|体感"),
    ("演奏会", "演奏会|コンサート|音楽隊"),
    ("記念行事", "記念行事|記念式典|観閲式|式典|周年記念"),
    ("記念行事", "記念|創立|周年"),
    ("広報活動", "はたらく車|働く車|はたらくくるま|はたらくクルマ|働くクルマ|がんばる車|はたらく乗り物|働く乗り物|車両展示|装備品|自衛隊展|自衛隊車両|特別展示"),
    ("地域参加", "まつり|祭り|マルシェ|フェスタ|フェスティバル|こどもまつり|子どもまつり|感謝祭|縁日|ウォーキング"),
    ("地域参加", "フェス|THANKS|ミーティング|こもれび|イコット|GW|ユメタウン|ゆめタウン|ショッピング|イオン|ボートレース|パーク|ランニング|サッカー|野球|スタジアム"),
]
OTHER_CATEGORY = "広報活動"

# Labels of a text, in order of display.
TAGS = [
    ("入場無料", "無料|入場無料"),
    ("要予約", "予約|申込|申し込み|事前|事前登録"),
    ("オンライン", "オンライン|Zoom|zoom|ウェブ"),
    ("家族向け", "家族|子ども|お子|ファミリー|親子"),
    ("学生向け", "高校生|中学生|学生|大学生|学校"),
    ("抽選", "抽選"),
    ("個別", "個別"),
    ("OB・OG", "OB|OG|元自衛官"),
]

# Fixed values: (branch, words that decide, words that decide only if none of the former occurs for any branch).
BRANCHES = [
    ("ground", "陸上自衛隊|陸自(?!衛)|駐屯地|方面隊|普通科|特科|機甲|戦車|高等工科学校", "装甲車|軽装甲機動車|偵察|レンジャー"),
    ("maritime", "海上自衛隊|海自(?!衛)|護衛艦|艦艇|掃海|潜水艦|地方隊|基地隊|体験航海|乗艦", "岸壁|ふ頭|埠頭|カッター"),
    ("air", "航空自衛隊|空自(?!衛)|航空祭|ブルーインパルス|飛行隊|高射群|レーダーサイト", "戦闘機|輸送機|救難|管制|航空機"),
]

# Phrases that only say an event may be cancelled, and those that say it is.
CANCEL_MASKS = [
    "(?:荒天|悪天候|雨天|降雨|台風|天候|気象条件)[^。]{0,6}?(?:の場合)?[^。]{0,4}?中止",
    "中止(?:又は|または|・)?(?:延期|変更)?(?:と|に)?なる場合",
    "中止(?:する|の)?(?:可能性|場合|おそれ|恐れ)",
    "中止の場合(?:が)?あ(?:り|る)",
    "(?:状況|事情)により(?:は)?[^。]{0,6}?中止",
    "中止(?:又は|または)変更",
]
CANCEL_SURE = [
    "開催(?:を)?中止",
    "中止(?:と|に)?なりました",
    "中止いた?しました",
    "中止(?:と|に)?します",
    "中止いたします",
    "中止のお知らせ",
    "本(?:イベント|行事|催し)(?:は)?(?:、)?[^。]{0,10}?中止",
    "(?:開催を)?見送(?:り|る|ります)",
    r"[【\[［(（]\s*(?:開催)?中\s*止\s*[】\]］)）]",
]
CLOSED_MASKS = [
    "定員に達し次第[^。]{0,4}?(?:締切|締め切|受付終了)",
    "締(?:切|め切)(?:り)?(?:予定|は?未定)",
    "(?:応募|申込|受付|募集)?[^。]{0,4}?(?:締切|締め切|期間|受付)(?:り)?を?延長",
    r"\d{1,2}\s*[:：]\s*\d{2}\s*(?:に|まで)?\s*受付(?:を)?終了",
    r"受付(?:を)?終了\s*[:：]?\s*\d{1,2}\s*[:：]\s*\d{2}",
    "受付(?:を)?終了(?:時刻|時間)",
    "(?:受付|募集|申込)(?:を)?(?:終了|締切|締め切り?)[^。]{0,4}?(?:可能性|場合|恐れ|おそれ|かも|することがあ)",
    "定員に達した場合",
]
CLOSED_SURE = [
    "受付(?:を)?終了(?:しました|いたしました)?",
    "募集(?:を)?終了(?:しました|いたしました)?",
    "申(?:込|し込)み?を?(?:締め切りました|締切りました|終了)",
    "応募(?:を)?(?:締め切りました|締切りました|終了)",
    "申込(?:み)?終了",
    "定員に達したため[^。]{0,6}?(?:受付|募集)?[^。]{0,4}?(?:終了|締切)",
    "締め切りました",
]
MASK = "〔条件付〕"

# Weekday names from Sunday.
WEEKDAYS = "日月火水木金土"


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose pattern the text has."""
    return reduce(lambda rest, r: F.when(text.rlike(r[1]), F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(default))


def all_matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The values of all rules whose patterns the text has, in the rules' order."""
    hits = F.array(*[F.when(text.rlike(p), F.lit(v)) for v, p in rules])
    return F.filter(hits, lambda x: x.isNotNull())


def mask_then_confirm(text: Column, masks: list[str], sure: list[str]) -> Column:
    """Whether a sure phrase is left in the text in half-width letters and single blanks, after every masking phrase has been blanked, in order."""
    plain = squeeze(half_width(F.coalesce(text, F.lit(""))))
    masked = replaced_all(plain, [(p, MASK) for p in masks])
    return F.coalesce(masked.rlike("|".join(f"(?:{p})" for p in sure)), F.lit(False))


def category(title: Column) -> Column:
    return first_match(F.coalesce(title, F.lit("")), CATEGORIES, OTHER_CATEGORY)


def tags(text: Column) -> Column:
    return all_matches(F.coalesce(text, F.lit("")), TAGS)


def known_tags(values: Column) -> Column:
    """Only known labels, once each, in the order of display."""
    return F.array_intersect(F.array(*[F.lit(v) for v, _ in TAGS]), values)


def branches(text: Column) -> Column:
    """Deciding words first; the weaker ones only where no branch has any."""
    strong = all_matches(text, [(b, s) for b, s, _ in BRANCHES])
    weak = all_matches(text, [(b, w) for b, _, w in BRANCHES])
    return F.when(F.size(strong) > 0, strong).otherwise(weak)


def cancelled(text: Column) -> Column:
    return mask_then_confirm(text, CANCEL_MASKS, CANCEL_SURE)


def closed(text: Column) -> Column:
    return mask_then_confirm(text, CLOSED_MASKS, CLOSED_SURE)


def status(text: Column, deadline: Column, today: Column) -> Column:
    """cancelled, then closed by text, then closed by a deadline gone by, else published."""
    return (
        F.when(cancelled(text), "cancelled").when(closed(text), "closed").when(deadline < today, "closed").otherwise("published")
    )


def sticky_status(before: Column, now: Column) -> Column:
    """A cancelled event stays so; a closed one does not open again."""
    return F.when(before == "cancelled", "cancelled").when((before == "closed") & (now == "published"), "closed").otherwise(now)
