"""Titles, places and addresses: spelling, cleaning in order, and the tests that keep a row from publication. All in the JVM, but for readings corrected by a table."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventloom.functions.scalars import bound, decoded_url, half_width, has_any, may_have, replaced_all, squeeze

#: Texts that Python takes out of a batch at once.
AT_ONCE = 64
#: Half-width kana, marks included, each with its full-width character; those with a sound mark first.
KANA = [chr(c) for c in range(0xFF61, 0xFFA0)]
MARKED = [(k + m, unicodedata.normalize("NFKC", k + m)) for k in KANA for m in "ﾞﾟ" if len(unicodedata.normalize("NFKC", k + m)) == 1]

# What is replaced in a title, in this order (pattern, replacement).
TITLE_STEPS = [
    (r"(?i)\s*[（(［\[【]\s*(?:PDF|Word|Excel|JPE?G|PNG)(?:\s*(?:形式|ファイル|版))?(?:\s*[:：,、/]?\s*[\d.,]+\s*(?:KB|MB|kB|キロバイト|メガバイト))?\s*(?:[）)］\]】]|$)", " "),
    (r"(?i)\s*[（(]\s*[\d.,]+\s*(?:KB|MB|kB)\s*[）)]", " "),
    (r"\s*[（(]?(?:別ウィンドウ|新しいウィンドウ|新規ウィンドウ)で開(?:きます|く)[）)]?", " "),
    (r"\s*[（(](?:外部リンク|外部サイト)[）)]", " "),
    (r"\s*[【（(［\[](?:詳細|詳しく)は?(?:こちら|コチラ)[!！]*[】）)］\]]", " "),
    (r"(?i)\s+(?:PDF|PDF版)$", ""),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"^[［\[【〔](?:イベント|イベント情報|行事|催し|催事|お知らせ|新着)[］\]】〕]\s*", ""),
    (r"^(?:説明会情報|イベント情報|行事予定)\s+", ""),
]
# The steps after an announcement's sentence has become a title.
TITLE_STEPS_AFTER = [
    (r"[（(]?クリックで拡大します。?[）)]?", " "),
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"^イベント情報\s*", ""),
    (r"^[^【】]{1,6}】\s*", ""),
    (r"^[~〜～\s]+", ""),
    (r"^(?:(?:イベント|事前予約制|予約制|予約不要|入場無料|参加無料|無\s*料)\s*){2,}", ""),
    (r"(?i)^(?:更新情報|新着情報|最新情報|更新|お知らせ)\s*(?:new|ＮＥＷ|新着)?[\s!！:：・]*", ""),
    (r"^[#＃]+\s*", ""),
    (r"^[★☆●○■□◆◇※]+\s*", ""),
    (r"^[&＆]+\s*", ""),
    (r"^(?:NEW|ＮＥＷ|新着)(?=[\s\d０-９!！/／&＆＼\\])[!！]*[\s\d０-９/／&＆.．＼\\]*", ""),
    (r"^\d\s*(?=[ァ-ヶ])", ""),
    (r"^\d\s+(?=20\d{2})", ""),
    (r"^(?=.*(?:説明会|ガイダンス|相談会|フェア|見学会).*(?:説明会|ガイダンス|相談会|フェア|見学会))(.*?(?:説明会|ガイダンス|相談会|フェア|見学会)(?:in[^\sの]+)?)の\s.*$", "$1"),
    (r"\s*【参加団体】.*$", ""),
    (r"\s*【場所】.*$", ""),
    (r"\s*参加費\s*無料[!！]*$", ""),
    (r"(?:\s*(?:入場無料|参加無料|参加費無料|どなたでも参加できます|予約不要|事前予約不要)[!！]*)+$", ""),
    (r"\s*(?:ご|お)?(?:応募|申し?込み?)は?(?:こちら|コチラ)[!！]*$", ""),
    (r"\s*の(?:お知らせ|ご案内)$", ""),
    (r"\s*(?:参加|開催)?募集の件$", ""),
    (r"\s*の件$", ""),
    (r"(?<=[）)])\s*[-－]\d{1,2}(?:\[[A-Za-z]*)?$", ""),
    (r"\s*の?\s*[（(]\s*[~〜～][^）)]*[）)]\s*$", ""),
    (r"\s*\S{0,4}[~〜～]令和[\d０-９元]{1,3}年度\S*(?:激励会|入隊|式典|説明会|見学|まつり).*$", ""),
    (r"[\x{1F000}-\x{1FAFF}\x{2700}-\x{27BF}\x{FE0F}\x{1F3FB}-\x{1F3FF}]+\s*$", ""),
    (r"([!！]{1,2})\s+\S*(?:プラザ|センター|ホール|会館|アトリウム|ビル|駐屯地|基地|分屯|庁舎|公園|体育館|ロビー|広場|[\d０-９][FＦ]).*$", "$1"),
    (r"[\s~〜～]+$", ""),
    (r"[のをがはにへと][\s!！。、,，~〜～]*$", ""),
    (r"[（(]\s*[）)]\s*$", ""),
    (r"(?<=説明会|見学会|相談会)同日$", ""),
    (r"^ +| +$", ""),
    (r"^([一-鿿ぁ-んァ-ヶーa-zA-Z0-9０-９]{2,10}(?:募集案内所|地域事務所|出張所))$", "自衛隊説明会（$1）"),
]
# Sentences that announce an event (pattern, title, place; $n are its groups).
ANNOUNCEMENTS = [
    (r"^[「｢『](.+?)[」｣』]\s*(?:に|へ|で)\s*(?:自衛隊)?ブース\s*を?\s*出展(?:します|いたします|しました|予定)?[!！。]*$", "$1（自衛隊ブース出展）", None),
    (r"^[「｢『](.+?)[」｣』]\s*(?:に|へ|で)\s*(?:自衛隊)?(?:ブース)?\s*を?\s*(出展|参加|出演)(?:します|いたします|しました|予定)?[!！。]*$", "$1（自衛隊$2）", None),
    (r"^(.+?)\s*にて\s*(?:自衛隊)?ブース\s*を?\s*出展(?:します|いたします)?[!！。]*$", "自衛隊ブース出展（$1）", "$1"),
    (r"^(.+?)\s*にて\s*(?:自衛隊)?\s*を?\s*出展(?:します|いたします)?[!！。]*$", "自衛隊出展（$1）", "$1"),
    (r"^(.+?)\s*に\s*(?:自衛隊)?ブース\s*を?\s*出展(?:します|いたします)[!！。]*\s*(?:[（(]([^）)]+)[）)])?$", "$1（自衛隊ブース出展）", "$2"),
    (r"^(.+?)\s*に\s*(?:自衛隊)?\s*を?\s*出展(?:します|いたします)[!！。]*\s*(?:[（(]([^）)]+)[）)])?$", "$1（自衛隊出展）", "$2"),
    (r"^(.+?)で\s*[「｢『](.+?)[」｣』]\s*を\s*(?:行|おこな)います[!！。]*$", "$2", "$1"),
    (r"^(.*?)\s*(?:は)?(?:開催)?予定です[!！。]*\s*(?:[（(][^）)]*現在[）)])?$", "$1", None),
]
QUOTED = "^[「｢『]"
PLACE_IN_BRACKETS = r"^(.+?)\s*[（(]([^（）()]*(?:市|町|村|区|郡|道の駅)[^（）()]*)[）)]\s*(（自衛隊[^）]*）)$"

EVENTS = "説明会|見学|体験|"
# Titles that are no event (pattern, pattern that saves them or None), read after half-width folding.
JUNK = [
    ("↑.*申し込み", None),
    ("【?お問合せ|お問い合わせ先", None),
    (r"〒\s*\d", None),
    (r"\d{2,4}[-－]\d{3,4}[-－]\d{4}", None),
    ("及び定員|提出書類|応募方法|様式第|試験期日|受験案内", None),
    ("(?:募集要[項项]|募集案内)$", None),
    ("(?:採用|資格)試験$", "説明会|見学|体験|相談|ガイダンス|フェア|セミナー"),
    ("タイトル不明", None),
    ("^乗艦受付|受付時刻$", None),
    ("最大射程|発射速度|排水量|巡航速度", None),
    (r"^\S{0,12}上空を(?:航過|通過)$", None),
    (r"^\S{1,6}地本公式$", None),
    (r"^内\s*容\s", None),
    ("(?:消防本部|行政事務組合|市役所|町役場)$", "説明会|見学|体験|まつり|祭|フェア|フェスタ|コンサート|ガイダンス|相談会"),
    ("第[1１一]回採用試験.*第[2２二]回採用試験", None),
    (r"航空自衛隊\s*阪神基地隊", None),
    ("^(?:防衛医科大学校|防衛大学校|(?:陸上自衛隊)?高等工科学校)$", None),
    ("^(?:一般曹候補生|自衛官候補生|幹部候補生|予備自衛官補?|医科・?[歯菌]科[幹韓]部|技術曹|貸費学生)(?:[・,、][一-鿿ァ-ヶa-zA-Z・]{0,15})?$", None),
    (r"丁目[\d０-９]{1,3}[-－‐][\d０-９]", None),
    ("入札公告|オープンカウンター|実施要領|仕様書|契約担当官", None),
    ("チラシを参照|参照願います", None),
    (r"(?i)^(?:ダウンロード|詳細|詳しくは|こちら|チラシ[\d０-９]*|PDF|画像|リンク)$", None),
    (r"^(?:詳しく(?:みる|見る)|詳細を(?:みる|見る)|詳細はこちら|もっと(?:みる|見る)|こちらから|(?:お?申し?込み?|申込|お申し込み)はこちら)[>＞›»→\s]*$", None),
    ("(?:コンテンツ(?:の)?利用について|利用規約|サイトポリシー|プライバシーポリシー|個人情報(?:の)?保護方針|著作権について|リンクについて)$", None),
    (r"^[（(]?\s*(?:\d{1,2}[:：]\d{2}\s*)?(?:受付終了|最終受付\s*\d{1,2}[:：]\d{2})\s*[）)]?$", None),
    (r"^(?:募集中[\s　]*)?【[^】]{2,30}】[\s　]*募集$", None),
    (r"ホームページ\s*[<＜]|[<＜]\s*自衛官募集|募集ホームページ$", None),
    ("(自衛官|[陸海空]士|曹候補生|幹部候補生|航空学生|予備自衛官補?)[^。]{0,20}募集(中)?$", "説明会|見学|体験|搭乗|ツアー|参加者|相談会|イベント|フェア|公開"),
    (r"(?:採用|探用)案内(?:\s*[（(][^）)]*[）)])?$", "説明会|相談会|ガイダンス|セミナー|フェア"),
    ("ダウンロード$", None),
    ("ダウンロード", "説明会|相談会|見学|体験|フェア|まつり|祭|公開|演奏会"),
    (r"(?i)^(?:PDF|Word|Excel)$|\.(?:pdf|docx?|xlsx?|jpe?g|png)$", None),
    ("申込み?リンク|応募リンク|広報申込み", None),
    (r"^(?:主催|共催|開催場所|場所|会場|日時|日程|お問合せ先?)\s*[:：]", None),
    ("申込み?(?:受付)?は終了(?:しました|いたしました)。?$|場合があります。?$", None),
    (r"^(?:受付|開催|開場|開始|終了)?時間\s*[:：]?\s*\d", None),
    (r"^[\d０-９]{1,2}\s+\S.*\s[\d０-９]{1,2}\s+\S", None),
    (r"^[\d０-９]{1,2}\s+(?:試験日|受付時間|受付|場所|会場|日時|時間|携行品|持ち物|注意事項|お問い?合わせ)", None),
    ("[这么们咱您吗呢�]", None),
    ("[亏]", None),
    (r"^(?:自衛隊)?(?:.{0,6}地本|募集案内所|地域事務所|出張所)?イベント(?:\s*（[^）]*）)?$", None),
    ("^(?:自衛隊)?.{1,6}地方協力本部の?イベント情報?$", None),
    ("^(?:陸上|海上|航空)?自衛隊(?:[一-鿿ァ-ヶー]{2,8}(?:病院|救難隊|音楽隊|基地|部隊|駐屯地))?$", None),
    ("[をがはにへとの、]$", None),
    ("(?:から|より)$", None),
]
# Words of an event; a title with one is not held back.
EVENT_WORDS = "(?i)説明会|見学|体験|搭乗|公開|まつり|祭|フェス|コンサート|演奏|相談|ガイダンス|ツアー|イベント|教室|大会|式典|行事|講演|セミナー|キャンプ|インターン|オープンキャンパス|オープンスクール|懇談|トークショー|トーク|ラリー|マルシェ|夜市|盆踊り|花火|パレード|展示|航空祭|募集案内|検定|入隊|激励会|音楽隊|ブース|ショー|フライト|クイズ|Quiz|day|フェア|納涼|夏市|就職|進学|採用|防災"
# Signs that a title without such a word is something else.
DOUBTS = [
    "(?:時刻|時間|方法|要領|一覧|概要|案内図|地図|アクセス|住所|連絡先|電話番号|料金|定員|持ち物|注意事項|受付|申込先|問合せ)$",
    "(?:本部|市役所|町役場|役場|警察署|消防署|組合|協会|連盟|事務局)$",
    "速度|射程|排水量|全長|全幅|口径|馬力",
    r"\d[,，]?\d*\s*(?:発|km|kt|ノット|mm|㎜|トン)\b",
    "(?:を|に|へ)[一-鿿]{1,4}$",
    "。$",
    r"^(?:内\s*容|日\s*時|場\s*所|会\s*場|期\s*間|対\s*象|主\s*催)\s",
    "公式$",
    "(?:ホール|センター|プラザ|会館|体育館|アリーナ|ターミナル|グラウンド|広場|岸壁|埠頭)$",
]
# Documents by title or place, by file name, by media file; words that save a title.
DOCUMENT = "福利厚生|待遇|給与|手当|共済|年金|宿舎|服務|利用規約|サイトポリシー|コンテンツ利用|著作権|求人をお考えの企業|退職自衛官の求人|採用案内冊子|招集教育|招集訓練|教育訓練日程"
DOCUMENT_FILE = "(?i)fukuri|kousei-kaizen|riyoukiyaku|kiyaku|privacy|sitepolicy|copyright|kyuyo|teate|kyosai"
MEDIA = r"(?i)\.(?:wav|mp3|m4a|aac|ogg|mp4|mov|wmv)(?:[?#]|$)"
DOCUMENT_SAVED = "説明会|見学|体験|フェス|まつり|祭|公開|展示|演奏|相談会|イベント|ツアー|大会|式典|行事|オープンキャンパス|セミナー|ガイダンス|フェア"
DOCUMENT_NOTES = "利用規約|サイトポリシー|コンテンツ利用"
# Texts of a field that stand for none; words of a venue; names of prefectures.
NO_TEXT = "(?i)^(null|undefined|なし|未定|不明|-|ー|―|—)?$"
VENUE = "会場|駐屯地|基地|分屯|港|駅|公園|ホール|センター|会館|プラザ|体育館|アリーナ|庁舎|大学|学校|モール|広場|グラウンド|市役所|町役場|役場|神社|寺|城|イオン|ドーム|スタジアム|球場|美術館|博物館|図書館"
PREFECTURES = "北海道|青森県|岩手県|宮城県|秋田県|山形県|福島県|茨城県|栃木県|群馬県|埼玉県|千葉県|東京都|神奈川県|新潟県|富山県|石川県|福井県|山梨県|長野県|岐阜県|静岡県|愛知県|三重県|滋賀県|京都府|大阪府|兵庫県|奈良県|和歌山県|鳥取県|島根県|岡山県|広島県|山口県|徳島県|香川県|愛媛県|高知県|福岡県|佐賀県|長崎県|熊本県|大分県|宮崎県|鹿児島県|沖縄県"
CITY = r"[一-鿿ぁ-んァ-ヶ]{1,6}[市区町村](?:[一-鿿ぁ-んァ-ヶ]{0,8})?[0-9０-９]{1,4}\s*(?:丁目|番地|番|号|[-−－])"


def full_kana(c: Column) -> Column:
    """Half-width kana and brackets to full width, sound marks joined; foreign middle dots to the Japanese one."""
    joined = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), MARKED, c)
    return F.translate(joined, "".join(KANA) + "·•∙", "".join(unicodedata.normalize("NFKC", k)[-1] for k in KANA) + "・・・")


def half_marks(c: Column) -> Column:
    """Digits and letters to half width, and the colon and waves to one form each."""
    return F.translate(half_width(c), "：〜~", ":～～")


def separators(c: Column) -> Column:
    """One slash, one full stop and one hyphen for those that dates are written with."""
    return F.translate(c, "／．－‐―ｰ", "/.----")


def native_kanji(c: Column, foreign: str = "", native: str = "") -> Column:
    """Characters of another script form to those of this one, by a table that the caller gives."""
    return F.translate(c, foreign, native)


def announcement(c: Column) -> Column:
    """struct(title, place) of a sentence that announces an event; other texts are their own title."""

    def told(t: Column) -> Column:
        title, place = t, F.lit("")
        for pattern, name, where in reversed(ANNOUNCEMENTS):
            hit = t.rlike(pattern)
            title = F.when(hit, F.regexp_replace(t, pattern, name)).otherwise(title)
            place = F.when(hit, F.regexp_replace(t, pattern, where) if where else F.lit("")).otherwise(place)
        inner = t.rlike(QUOTED) & title.rlike(PLACE_IN_BRACKETS)
        place = F.when(inner, F.regexp_replace(title, PLACE_IN_BRACKETS, "$2")).otherwise(place)
        title = F.when(inner, F.regexp_replace(title, PLACE_IN_BRACKETS, "$1$3")).otherwise(title)
        return F.struct(F.trim(title).alias("title"), F.trim(F.coalesce(place, F.lit(""))).alias("place"))

    some = [QUOTED, *[p for p, _, _ in ANNOUNCEMENTS]]
    return bound(F.trim(c), lambda t: F.when(may_have(t, some), told(t)).otherwise(F.struct(t.alias("title"), F.lit("").alias("place"))))


def clean_title(c: Column) -> Column:
    """struct(title, place): the title of an event without what surrounds it on a page."""
    first = replaced_all(half_width(squeeze(full_kana(c))), TITLE_STEPS)
    return bound(announcement(first), lambda said: F.struct(replaced_all(said["title"], TITLE_STEPS_AFTER).alias("title"), said["place"].alias("place")))


def no_text(c: Column) -> Column:
    return c.isNull() | F.trim(c).rlike(NO_TEXT)


def clean_place(c: Column) -> Column:
    """A venue without table marks, a geocoder's tail or a postal code; lists of offices are none."""
    steps = [(r"^[|｜\s]+|[|｜\s]+$", ""), (r"[,、]\s*日本[,、].*$", ""), (r"[,、]?\s*〒\s*\d{3}-?\d{0,4}.*$", "")]

    def checked(p: Column) -> Column:
        several = p.contains("・") & (F.regexp_count(p, F.lit("事務所|案内所|出張所|分駐所")) >= 2)
        bare = p.startswith("・") & ~p.rlike(VENUE)
        return F.when(no_text(c) | p.rlike(r"ほか\d+拠点$") | several | bare, "").otherwise(p)

    return bound(F.trim(replaced_all(squeeze(full_kana(c)), steps)), checked)


def split_place(place: Column, address: Column) -> Column:
    """struct(place, address): an address within a venue's text goes to the address, unless one is there."""
    p, own = squeeze(F.coalesce(place, F.lit(""))), F.trim(F.coalesce(address, F.lit("")))
    out = F.struct(p.alias("place"), own.alias("address"))
    for mark in (CITY, f"(?:{PREFECTURES})"):
        head = F.regexp_replace(F.regexp_extract(p, f"^(.+?)({mark}.*)$", 1), r"[\s（(、,・]+$", "")
        tail = F.regexp_replace(F.regexp_replace(F.regexp_extract(p, f"^(.+?)({mark}.*)$", 2), r"^[\s（(]+", ""), r"[）)\s]+$", "")
        split = F.struct(head.alias("place"), F.when(own != "", own).otherwise(tail).alias("address"))
        out = F.when((head != "") & (tail != ""), split).otherwise(out)
    return out


def plain_address(c: Column) -> Column:
    """An address without its postal code, in single spaces and half-width letters.

    Seven digits without mark or hyphen are one only where a word begins: elsewhere they number a house.
    """
    code = r"〒\s*\d{3}[-－―ー]?\d{4}|\s*\d{3}[-－―ー]\d{4}|(?<![^\s　])\d{7}(?!\d)"
    return squeeze(half_width(F.regexp_replace(F.coalesce(c, F.lit("")), code, " ")))


def foreign_script(c: Column) -> Column:
    """Replacement characters, or characters that Japanese never has."""
    return F.coalesce(c.rlike("[这么们咱您吗呢�]"), F.lit(False))


def junk_title(c: Column) -> Column:
    """Whether a title is certainly none of an event."""

    def junk(t: Column) -> Column:
        sentence = t.contains("。") & (F.char_length(t) >= 30)
        bare = (F.char_length(F.regexp_replace(t, "[^぀-ヿ㐀-䶿一-鿿]+", "")) < 3) & ~t.rlike("[A-Za-z]{4,}")
        return has_any(t, JUNK) | sentence | bare

    return c.isNull() | (c == "") | bound(half_width(F.trim(c)), junk)


def doubtful_title(c: Column, approved: tuple[str, ...] = ()) -> Column:
    """Whether a title is to be held back: no word of an event, and a sign of something else."""
    t = half_width(F.trim(c))
    saved = reduce(lambda a, b: a | b, [t.contains(a) for a in approved], t.rlike(EVENT_WORDS))
    return F.coalesce((c != "") & ~saved & reduce(lambda a, b: a | b, [t.rlike(p) for p in DOUBTS]), F.lit(False))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)


def document(title: Column, place: Column, notes: Column, url: Column) -> Column:
    """Whether a row is a document or a recording rather than an event."""
    t = half_width(F.coalesce(title, F.lit("")))
    u = decoded_url(F.coalesce(url, F.lit("")))
    named = t.rlike(DOCUMENT) | F.coalesce(place, F.lit("")).rlike(DOCUMENT) | file_name(u).rlike(DOCUMENT_FILE) | F.coalesce(notes, F.lit("")).rlike(DOCUMENT_NOTES)
    return u.rlike(MEDIA) | (~t.rlike(DOCUMENT_SAVED) & named)


def _years(text: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda y: y.cast("int"))


def stale(title: Column, url: Column, date: Column) -> Column:
    """Whether title or URL name a year before the event's; fiscal years must be two behind."""
    year = F.try_to_number(F.left(date, F.lit(4)), F.lit("9999")).cast("int")
    t, u = half_width(F.coalesce(title, F.lit(""))), F.coalesce(url, F.lit(""))
    both = F.concat(t, F.lit(" "), decoded_url(u))
    told = t.rlike(r"20\d{2}") | both.rlike("令和|平成") | u.rlike(r"/20\d{6}|[RrHh]\d{1,2}[.\-_]")  # most say no year at all
    past = F.exists(_years(t, r"(?<!\d)(20\d{2})(?!\d)"), lambda y: y < year)
    for era, base in (("令和", 2018), ("平成", 1988)):
        said = F.transform(F.regexp_extract_all(both, F.lit(rf"{era}\s*((?:元|\d{{1,2}})\s*年度?)"), F.lit(1)), lambda x: F.struct(F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(1)).alias("n"), x.endswith("度").alias("fiscal")))
        past = past | F.exists(said, lambda x: F.when(x["fiscal"], x["n"] + base <= year - 2).otherwise(x["n"] + base < year))  # noqa: B023
    stamp = F.regexp_extract(u, r"(?i)/(20\d{2})\d{4}[^/]*\.(?:pdf|jpe?g|png|gif)", 1).try_cast("int")
    for letter, base in (("[Rr]", 2018), ("[Hh]", 1988)):
        past = past | F.exists(_years(u, rf"(?<![A-Za-z0-9]){letter}(\d{{1,2}})[.\-_]\d{{1,2}}[.\-_]\d{{1,2}}"), lambda y: y + base < year)  # noqa: B023
    return F.when(told, F.coalesce(past | F.coalesce(stamp < year, F.lit(False)), F.lit(False))).otherwise(False)


def far_future(title: Column, url: Column, source: Column, date: Column, today: Column) -> Column:
    """'strong' or 'warn' for a date that text recognition put a year or two ahead without the year standing anywhere."""
    days, year = F.datediff(date.cast("date"), today.cast("date")), F.year(date.cast("date"))
    u = decoded_url(F.coalesce(url, F.lit("")))
    t = half_width(F.coalesce(title, F.lit("")))
    both, reiwa = F.concat(t, F.lit(" "), u), F.regexp_extract_all(F.concat(t, F.lit(" "), u), F.lit(r"(?i)(?:令和\s*|(?<![A-Za-z0-9])R)(\d{1,2})(?=[^\d]|$)"), F.lit(1))
    evident = F.array_contains(_years(both, r"(?<!\d)(20\d{2})(?!\d)"), year) | F.array_contains(reiwa, (year - 2018).cast("string"))
    earlier = F.exists(_years(F.concat(t, F.lit(" "), file_name(u)), r"(?<!\d)(20\d{2})(?:0[1-9]|1[0-2])?(?!\d)"), lambda y: y < year)
    doubt = source.rlike("^office_ocr|^office_crawl|ocr") & (days >= 365) & ~evident
    return F.when(doubt, F.when(earlier | (days >= 730), "strong").otherwise("warn"))


def publishable(title: Column, place: Column, notes: Column, url: Column) -> Column:
    """Whether a row counts under the rules of titles and documents."""
    return F.coalesce(title != "", F.lit(False)) & ~junk_title(title) & ~doubtful_title(title) & ~document(title, place, notes, url)


def corrected(c: Column, pairs: dict[str, str], rounds: int = 3) -> Column:
    """A text in which each misreading is replaced, the leftmost first and of those that begin there the longest, again until nothing changes, ``rounds`` times at most.

    A round is one walk over a text by one pattern: what a replacement writes is read again in the next
    round only. An empty misreading is passed over.
    """
    known = {k: v for k, v in pairs.items() if k}
    if not known:
        return c
    found = re.compile("|".join(re.escape(k) for k in sorted(known, key=len, reverse=True)))

    def whole(text: str | None) -> str | None:
        for _ in range(rounds if text else 0):
            before, text = text, found.sub(lambda m: known[m[0]], text)
            if text == before:
                break
        return text

    @F.arrow_udf(StringType())
    def corrections(texts: pa.Array) -> pa.Array:
        # a few texts at a time, which bounds what Python holds of a batch
        parts = [pa.array([whole(t) for t in texts.slice(i, AT_ONCE).to_pylist()], pa.string()) for i in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return corrections(c)
