"""Text operators over the whole ``part`` table: every part gets one of the sample texts, with its key in it where ``{k}`` stands.

The SQL joins the same parts with what each sample must give, stated by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.functions import quality as Q
from eventloom.functions import rules as R
from eventloom.functions import scalars as S
from eventloom.functions import titles as T
from eventloom.operators import layouts as L
from eventloom.sources import pages as P
from eventloom.sources import sinks as K
from eventloom.sources.tables import table

TODAY = "2026-08-18"
QUERIES: dict = {}
ORACLES: dict = {}


def literal(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"cast({x} as double)"
    return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def cases(name: str, columns: str, apply: Callable[..., Sequence[Column]], rows: list[tuple[object, object]]) -> None:
    """Registers a query: ``apply`` to the samples (a text or a tuple of texts), and what they must give."""
    names = columns.split()
    inputs = [r[0] if isinstance(r[0], tuple) else (r[0],) for r in rows]
    outputs = [r[1] if isinstance(r[1], tuple) else (r[1],) for r in rows]
    fields = [f"in{i}" for i in range(len(inputs[0]))]

    def query(spark, sf: str) -> DataFrame:
        samples = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], "i int, " + ", ".join(f"{f} string" for f in fields))
        # a file of keys alone is so small that one task would read it: the work on them is dealt to all cores
        keys = table(spark, sf, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
        parts = keys.select("p_partkey", (F.col("p_partkey") % len(rows)).cast("int").alias("i")).join(F.broadcast(samples), "i")
        filled = [F.replace(F.col(f), F.lit("{k}"), F.col("p_partkey").cast("string")) for f in fields]
        return parts.select("p_partkey", *[c.alias(n) for c, n in zip(apply(*filled), names, strict=True)])

    texts = {j for j in range(len(names)) if any(isinstance(o[j], str) for o in outputs)}
    shown = [f"replace({n}, '{{k}}', cast(p_partkey as varchar)) as {n}" if j in texts else n for j, n in enumerate(names)]
    values = ", ".join(f"({i}, {', '.join(map(literal, o))})" for i, o in enumerate(outputs))
    QUERIES[name] = query
    ORACLES[name] = f"with s(i, {', '.join(names)}) as (values {values}) select p_partkey, {', '.join(shown)} from part join s on p_partkey % {len(rows)} = i"


cases("title_cleaned", "title place", lambda c: (T.clean_title(c)["title"], T.clean_title(c)["place"]), [
    ("  第{k}回　説明会（PDF：600KB） ", ("第{k}回 説明会", "")),
    ("【お知らせ】航空祭{k}のご案内", ("航空祭{k}", "")),
    ("「あきたモーターショー{k}(秋田市)」に自衛隊ブース出展します", ("あきたモーターショー{k}（自衛隊ブース出展）", "秋田市")),
    ("別府市で「護衛艦公開{k}」を行います。", ("護衛艦公開{k}", "別府市")),
    ("イオンモール{k}にて自衛隊ブース出展します", ("自衛隊ブース出展（イオンモール{k}）", "イオンモール{k}")),
    ("# 海上自衛隊コンサート", ("海上自衛隊コンサート", "")),
    ("NEW6/14&7/11 自衛隊説明会", ("自衛隊説明会", "")),
    ("1オンライン説明会", ("オンライン説明会", "")),
    ("公務員合同説明会入場無料！！どなたでも参加できます！！", ("公務員合同説明会", "")),
    ("２０２６サマーキャンプの", ("2026サマーキャンプ", "")),
    ("京都募集案内所", ("自衛隊説明会（京都募集案内所）", "")),
    ("｢はたらく車大集合!｣", ("「はたらく車大集合!」", "")),
    ("音楽まつり（クリックで拡大します。）", ("音楽まつり", "")),
    ("艦艇広報】護衛艦見学", ("護衛艦見学", "")),
])
cases("kana_width", "wide narrow", lambda c: (T.full_kana(c), T.half_marks(c)), [
    ("ﾊﾞｽﾂｱｰ{k}", ("バスツアー{k}", "ﾊﾞｽﾂｱｰ{k}")), ("ﾊﾟﾚｰﾄﾞ·ｼｮｰ", ("パレード・ショー", "ﾊﾟﾚｰﾄﾞ·ｼｮｰ")), ("１０：３０〜ＡＢｃ", ("１０：３０〜ＡＢｃ", "10:30～ABc")), ("ｳﾞｧｲｵﾘﾝ", ("ヴァイオリン", "ｳﾞｧｲｵﾘﾝ")), (None, (None, None)),
])
cases("separators_plain", "plain address", lambda c: (T.separators(c), T.plain_address(c)), [
    ("2026／8／22", ("2026/8/22", "2026／8／22")), ("2026．8．22－23", ("2026.8.22-23", "2026．8．22－23")), ("〒123-4567 東京都　港区{k}", ("〒123-4567 東京都　港区{k}", "東京都 港区{k}")), ("〒1234567ＡＢ", ("〒1234567ＡＢ", "AB")),
])
cases("kanji_native", "native", lambda c: (T.native_kanji(c, "关东车", "関東車"),), [("关山{k}", "関山{k}"), ("东京の车", "東京の車"), ("関東", "関東")])
cases("announced", "title place", lambda c: (T.announcement(c)["title"], T.announcement(c)["place"]), [
    ("防災フェア{k}に出展します（駅前広場）", ("防災フェア{k}（自衛隊出展）", "駅前広場")),
    ("『夏まつり(弘前市)』に自衛隊参加します", ("夏まつり（自衛隊参加）", "弘前市")),
    ("体験航海は開催予定です(9/4 12時現在)", ("体験航海", "")),
    ("ただの説明会{k}", ("ただの説明会{k}", "")),
])
cases("place_cleaned", "place", lambda c: (T.clean_place(c),), [
    ("| 郡山{k}ホール |", "郡山{k}ホール"), ("関山演習場, 日本、〒944-0000 新潟県", "関山演習場"), ("公園 〒123-4567 住所", "公園"), ("盛岡ほか3拠点", ""), ("盛岡案内所・一関出張所", ""), ("・見学・体験", ""), ("・駅前広場", "・駅前広場"), ("未定", ""), ("null", ""), (None, ""),
])
cases("place_split", "place address", lambda p, a: (T.split_place(p, a)["place"], T.split_place(p, a)["address"]), [
    (("郡山労働福祉会館 郡山市虎丸町7番7号", ""), ("郡山労働福祉会館", "郡山市虎丸町7番7号")),
    (("ホール{k}（東京都港区1）", ""), ("ホール{k}", "東京都港区1")),
    (("東京都港区1", ""), ("東京都港区1", "")),
    (("会館 大阪府大阪市", "別の住所"), ("会館", "別の住所")),
    (("ただの会場{k}", None), ("ただの会場{k}", "")),
])
cases("title_tests", "junk doubtful is_foreign", lambda c: (T.junk_title(c), T.doubtful_title(c), T.foreign_script(c)), [
    ("↑申し込みはこちら↑", (True, False, False)), ("第{k}回自衛隊説明会", (False, False, False)), ("乗艦受付時刻", (True, True, False)), ("03-1234-5678", (True, False, False)),
    ("海上自衛隊", (True, False, False)), ("自衛官候補生採用試験", (True, False, False)), ("採用試験説明会", (False, False, False)), ("二戸地区広域行政事務組合消防本部", (True, True, False)),
    ("イーストピアみやこ多目的ホール", (False, True, False)), ("つばめのチカラ{k}", (False, False, False)), ("这是活动", (True, False, True)), ("PDF", (True, False, False)),
    ("最新の", (True, False, False)), ("航空学生募集", (True, False, False)), ("体験搭乗 参加者募集", (False, False, False)), ("主催：地本", (True, False, False)), ("県民の日", (False, False, False)), ("", (True, False, False)),
])
cases("row_tests", "is_document countable", lambda t, p, n, u: (T.document(t, p, n, u), T.publishable(t, p, n, u)), [
    (("福利厚生のご案内資料", "", "", ""), (True, False)), (("福利厚生説明会{k}", "", "", ""), (False, True)), (("ラジオ放送の録音", "", "", "https://a.jp/x.wav?1"), (True, False)),
    (("夏まつり{k}", "", "利用規約を読む", ""), (False, True)), (("お知らせ一覧表", "", "", "https://a.jp/kiyaku.html"), (True, False)), ((None, "会館", "", ""), (False, False)),
])
cases("stale_rows", "stale", lambda t, u, d: (T.stale(t, u, d),), [
    (("航空祭2024", "", "2026-05-01"), True), (("航空祭2026", "", "2026-05-01"), False), (("令和6年演奏会", "", "2026-05-01"), True), (("令和7年度説明会", "", "2026-05-01"), False), (("令和6年度説明会", "", "2026-05-01"), True),
    (("説明会", "https://a.jp/20241027_x.pdf", "2026-05-01"), True), (("説明会", "https://a.jp/R6.9.23.pdf", "2026-05-01"), True), (("説明会", "https://a.jp/R8.9.23.pdf", "2026-05-01"), False), (("平成元年の会", "", "2026-05-01"), True), (("説明会{k}回", None, "x"), False),
])
cases("far_dates", "doubt", lambda t, u, s, d: (T.far_future(t, u, s, d, F.lit(TODAY)),), [
    (("説明会", "", "office_ocr", "2028-09-01"), "strong"), (("説明会", "", "office_ocr", "2027-10-01"), "warn"), (("説明会2027", "", "office_ocr", "2027-10-01"), None), (("説明会", "https://a.jp/toyota_se202606_11.jpg", "office_ocr", "2027-10-01"), "strong"),
    (("令和9年説明会", "", "office_ocr", "2027-10-01"), None), (("説明会", "", "html", "2028-09-01"), None), (("説明会", "", "office_ocr", "2026-10-01"), None),
])
cases("date_first", "day n", lambda c: (D.first_date(c, F.lit(TODAY)), F.size(D.mentions(c))), [
    ("開催 令和8年9月5日（土）に実施", ("2026-09-05", 2)), ("2026/00/00 と 2026年10月3日", ("2026-10-03", 3)), ("8月22日(土)", ("2026-08-22", 1)), ("8月22日(月)", (None, 1)), ("8月22日(日)", ("2027-08-22", 1)), ("日時 9/12 午前", ("2026-09-12", 1)),
    ("比率は 9/12 です", (None, 0)), ("９／１２（土）", ("2026-09-12", 1)), ("1月10日", ("2027-01-10", 1)), ("5月10日", (None, 1)), ("なし{k}", (None, 0)), ("2025.3.1", (None, 1)),
])
cases("weekday_clash", "clash", lambda c, d: (D.weekday_conflict(c, d),), [(("9月5日（土）", "2026-09-05"), False), (("9月5日（日）", "2026-09-05"), True), (("9月5日（日）と9月5日（土）", "2026-09-05"), False), (("9月6日（土）", "2026-09-05"), False), (("文{k}", "2026-09-05"), False)])
cases("deadline_days", "day has_year reliable", lambda c, e: (D.deadline(c, e)["date"], D.deadline(c, e)["has_year"], D.deadline(c, e)["reliable"]), [
    (("12月20日（日）必着", "2027-01-10"), ("2026-12-20", False, True)), (("令和8年7月1日", "2026-08-01"), ("2026-07-01", True, True)), (("7月1日（月）", "2026-08-01"), ("2026-07-01", False, False)), (("なし", "2026-08-01"), (None, False, False)),
    (("7月1日", "x"), (None, False, False)), (("R元年5月1日", "2019-06-01"), ("2019-05-01", True, True)), (("平成31年4月1日(祝)", "2019-06-01"), ("2019-04-01", True, True)), (("2026年2月30日", "2026-08-01"), (None, False, False)), ((None, "2026-08-01"), (None, False, False)),
])
cases("deadline_shown", "day text", lambda c: (D.shown_deadline(c, F.lit(TODAY)), D.clean_deadline(c)), [
    ("9月1日まで", ("2026-09-01", "9月1日まで")), ("8月1日", ("2026-08-01", "8月1日")), ("5月1日", ("2027-05-01", "5月1日")), ("7/8 wed.", (None, "7月8日（水）")), ("null", (None, "")), (None, (None, "")), ("12/24", (None, "12月24日")),
])
cases("time_cleaned", "time", lambda c: (D.clean_time(c),), [
    ("１０時から１５時３０分", "10:00～15:30"), ("午前9時半〜午後3時", "09:30～15:00"), ("午後1:30-午後4:00", "13:30～16:00"), ("8/28(金）10:00～15:00", "10:00～15:00"), ("0930-1200", "09:30～12:00"), ("終日", "終日"), ("一般公開時間", ""), ("未定", ""),
    ("10:00（9:30受付開始）～12:00", "10:00～12:00"), ("①10:00②15:00", "10:00／15:00"), ("第1部10:00～12:00 第2部13:00～15:00", "10:00～12:00／13:00～15:00"), ("10:30～11:30、13:30～14:30", "10:30～11:30／13:30～14:30"), ("10時 ※雨天中止", "10:00"), (None, ""),
])
cases("time_ranges", "starts ends", lambda c: (D.time_range(c)["start"], D.time_range(c)["end"]), [("9:00～14:30", ("09:00", "14:30")), ("14:30~09:00", (None, None)), ("10:00", (None, None)), (" 08:05 - 08:06 ", ("08:05", "08:06")), ("25:00～26:00", (None, None)), (None, (None, None))])
cases("date_plain", "day", lambda c: (D.plain_date(c),), [("2026/8/2", "2026-08-02"), ("２０２６年８月２日（日）", "2026-08-02"), ("令和8年8月2日", "2026-08-02"), ("2026-02-30", None), ("8月2日", None), (None, None)])
cases("future_dates", "n", lambda c: (D.future_marks(c, F.lit(TODAY)),), [("令和8年9月5日と2026年9月5日と9月5日", 1), ("9月1日、9月2日、9月3日", 3), ("8月1日、7月1日", 0), ("1月10日", 1), ("2025年9月1日", 0), ("文{k}", 0), ("2026/10/1 と 10月2日", 2)])
cases("era_years", "year", lambda e, n: (S.era_year(e, n),), [(("令和", "元"), 2019), (("令和", "8"), 2026), (("平成", "31"), 2019), (("昭和", "64"), None)])
cases("year_likely", "year", lambda m, d, w: (D.likely_year(m.cast("int"), d.cast("int"), w, F.lit(TODAY)),), [(("8", "22", "土"), 2026), (("8", "22", "日"), 2027), (("8", "22", "月"), None), (("8", "12", ""), 2026), (("8", "1", ""), None), (("2", "30", ""), None), (("1", "10", ""), 2027)])
cases("status_words", "is_cancelled is_closed", lambda c: (R.cancelled(c), R.closed(c)), [
    ("荒天の場合は中止", (False, False)), ("【中　止】説明会", (True, False)), ("開催を中止しました", (True, False)), ("１０：００ 受付終了", (False, False)), ("受付終了しました", (False, True)), ("定員に達し次第締切", (False, False)), ("定員に達したため受付を終了", (False, True)), ("説明会{k}", (False, False)), (None, (False, False)),
])
cases("rule_labels", "category tags branches", lambda c: (R.category(c), F.array_join(R.tags(c), ","), F.array_join(R.branches(c), ",")), [
    ("オープンキャンパス{k}", ("説明会", "", "")), ("護衛艦一般公開 入場無料", ("一般公開", "入場無料", "maritime")), ("ブルーインパルス飛行", ("広報活動", "", "air")), ("駐屯地創立記念 要予約 家族", ("記念行事", "要予約,家族向け", "ground")), ("装甲車の展示", ("広報活動", "", "ground")), ("夏まつり オンライン", ("地域参加", "オンライン", "")),
])
cases("bot_agents", "bot", lambda c: (S_views(c),), [("Mozilla/5.0 (iPhone) Line/13", False), ("facebookexternalhit/1.1", True), ("okhttp/4.9", True), ("axios/1.2", True), ("Java/17", True), ("", True), (None, True), ("Chrome-Lighthouse", True), ("Mozilla/5.0 {k}", False)])
cases("view_ids", "countable", lambda c: (Q.countable_id(c),), [("ev-{k}", True), ("ev~2", False), ("-a", False), ("a" * 120, True), ("a" * 121, False), (None, False)])
cases("short_hash_units", "hash", lambda c: (S.short_hash(c),), [("2026-01-01-a", "4asq7"), ("", "0045h"), ("😀祭", "wa6t1"), ("護衛艦", "nzs3z")])
cases("query_checks", "error limit_ offset_", lambda f, t, s, n, o: tuple(Q.checked_query({"from": f, "to": t, "status": s, "limit": n, "offset": o})[x] for x in ("error", "limit", "offset")), [
    (("2026-01-01", "2026-02-01", "", "10", "5"), (None, 10, 5)), (("2026-02-30", "", "", "", ""), ("invalid from", None, None)), (("2026-02-01", "2026-01-01", "", "", ""), ("from after to", None, None)), (("", "", "gone", "", ""), ("invalid status", None, None)), (("", "", "draft", "101", ""), ("invalid limit", None, None)), (("", "", "", "", "-1"), ("invalid offset", None, None)), ((None, None, None, None, None), (None, 50, 0)),
])
cases("scopes", "allowed", lambda r, o, own, p, f: (Q.in_scope(r, o, own, F.lit(True), p, f),), [
    (("national_admin", "", "", "", ""), True), (("pco_admin", "tokyo", "", "tokyo", "x"), True), (("pco_admin", "tokyo", "", "osaka", ""), False), (("office_editor", "tokyo", "a", "tokyo", "a"), True), (("office_editor", "tokyo", "a", "tokyo", ""), False), (("office_manager", "tokyo", "", "tokyo", ""), False), (("x", "*", "", "", ""), True), ((None, None, None, "tokyo", "a"), False),
])
cases("source_pairs", "same_url same_row", lambda a, b, t, u: (Q.same_source(a, b), Q.same_event({"id": F.lit("1"), "pref": F.lit("p"), "date": F.lit("d"), "url": a, "title": t}, {"id": F.lit("1"), "pref": F.lit("p"), "date": F.lit("d"), "url": b, "title": u})), [
    (("https://A.jp/x/index.html", "http://a.jp/x/", "甲", "乙"), (True, True)), (("https://a.jp/x?i=1", "https://a.jp/x?i=2", "甲の会", "乙の会"), (False, False)), (("", "", "自衛隊説明会（昼）", "説明会"), (False, True)), (("", "", "", ""), (False, False)),
])
cases("lost_notes", "lost shrunk", lambda a, b: (F.array_join(Q.notes_change(a, b)["lost"], ","), Q.notes_change(a, b)["shrunk"]), [(("抽選で定員50名{k}", "詳細は後日お知らせします"), ("抽選,定員", False)), (("抽選で定員50名", "抽選です"), ("", False)), (("とても長い備考がここに書かれています", "短い"), ("", True))])
cases("removed_fields", "place_ deadline_", lambda c: (Q.removed("place", c), Q.removed("deadline", c)), [("会場未定です", (True, False)), ("予約不要{k}", (False, True)), ("ふつうの文", (False, False)), (None, (False, False))])
cases("loose_json_found", "title", lambda c: (F.try_variant_get(Q.loose_json(c), "$.t", "string"),), [('答えは {"t": "会{k}"} です', "会{k}"), ('```{"t":"b"}```', "b"), ("{broken", None), ('{"t": }', None), (None, None)])
cases("bracketed", "day place_ notes_", lambda c: tuple(F.try_element_at(L.bracket_fields(c), F.lit(x)) for x in ("date", "place", "notes")), [("【日時】9月{k}日【場所】会館【会場】別館", ("9月{k}日", "会館", None)), ("【内容】見学【謎】x", (None, None, "見学")), (None, (None, None, None))])
cases("recurrences", "days", lambda c: (F.array_join(L.recurring(c, F.lit(2026)), ","),), [("10月(毎週月・木)", "2026-10-01,2026-10-05,2026-10-08,2026-10-12,2026-10-15,2026-10-19,2026-10-22,2026-10-26,2026-10-29"), ("２月（毎週日曜日）", "2026-02-01,2026-02-08,2026-02-15,2026-02-22"), ("10月1日", "")])
cases("day_lists", "days spans", lambda c: (F.array_join(L.listed_days(c, F.lit(2026)), ","), F.array_join(F.transform(L.day_spans(c, F.lit(2026)), lambda s: F.concat_ws("..", s["date"], s["end"])), ",")), [
    ("12月4日、5日、6日", ("2026-12-04,2026-12-05,2026-12-06", "2026-12-04,2026-12-05,2026-12-06")), ("12月4日～6日", ("2026-12-04,2026-12-06", "2026-12-04..2026-12-06")), ("11月30日、12月1日", ("2026-11-30,2026-12-01", "2026-11-30,2026-12-01")), ("2月30日", ("", ""))])
cases("map_locations", "urls", lambda c: (F.array_join(L.locations(c), " "),), [("<url><loc> https://a.jp/{k} </loc></url><url><LOC>https://a.jp/b?x=1&amp;y=2</LOC></url>", "https://a.jp/{k} https://a.jp/b?x=1&y=2"), ("", "")])
cases("id_bases", "id_", lambda c: (L.base_id(c),), [("ev{k}~2", "ev{k}"), ("ev~a", "ev~a"), ("ev", "ev")])

cases("plain_texts", "squeezed dedup fuzzy", lambda c: (S.squeeze(S.half_width(c)), S.dedup_key(c), S.fold_kana(F.regexp_replace(c, r"\s+", ""))), [("　Ａ１  b{k}\n", ("A1 b{k}", "A1b{k}", "　ａ１b{k}")), ("自衛隊 ひろば（昼）【夜】", ("自衛隊 ひろば（昼）【夜】", "ひろば", "自衛隊ヒロバ（昼）【夜】")), ("部隊見学・祭り!", ("部隊見学・祭り!", "見学祭り", "部隊見学・祭リ!"))])
cases("file_names", "name asset", lambda c: (S.url_basename(c), c.rlike(r"(?i)\.(?:pdf|jpe?g|png|gif|webp)(?:[?#]|$)")), [("https://a.jp/x/Flyer{k}.PDF?a=1", ("flyer{k}", True)), ("https://a.jp/x.html", ("", False)), ("/a/b.jpeg", ("b", True))])
cases("clean_fields", "cleaned masked cell", lambda c: (S.clean_field(c, 20), S.mask_contact(c), S.safe_cell(c)), [
    ("<b>7\n x", ("＜b＞7 x", "<b*** x", "<b>7\n x")), ("taro@a.jp", ("taro@a.jp", "ta**@a.jp", "taro@a.jp")), ("=1+2", ("=1+2", "****", "'=1+2")), ("a\u200b\u202eb\x07", ("ab", "a\u200b*b\x07", "a\u200b\u202eb\x07")), ("ab", ("ab", "**", "ab")), ("t@a.jp", ("t@a.jp", "t*@a.jp", "t@a.jp")), (" 090-1234-5678 ", ("090-1234-5678", "09*********78", " 090-1234-5678 ")), ("a\t\r\n　b", ("a b", "a\t**　b", "a\t\r\n　b"))])
cases("escapes", "html ics", lambda c: (S.escape_html(c), S.escape_ics(c)), [("<a href=\"x\">'&{k}", ("&lt;a href=&quot;x&quot;&gt;&#39;&amp;{k}", "<a href=\"x\">'&{k}")), ("a;b,c\\d\ne", ("a;b,c\\d\ne", "a\\;b\\,c\\\\d\\ne"))])
cases("spoilt_texts", "repeated worse", lambda a, b: (S.repeated_phrase(a), S.degraded(a, b)), [(("横須賀基地", "横賀基地"), (False, True)), (("横須賀基地", "横須賀"), (False, False)), (("合同説明会です合同説明会です", "合同説明会です合同説明会です"), (True, False)), (("合同 説明会です\n合同説明　会です", "x"), (True, False)), (("abc", "ac"), (False, False)), (("横 須賀　基地", "横賀基 地"), (False, True))])
cases("name_labels", "label tags", lambda c: (S.names_label(F.split(c, ","), 2), F.array_join(R.known_tags(F.split(c, ",")), ",")), [("東京{k},大阪,名古屋", ("東京{k}・大阪 ほか1拠点", "")), ("甲,甲", ("甲", "")), ("抽選,入場無料,謎", ("抽選・入場無料 ほか1拠点", "入場無料,抽選"))])
cases("real_days", "real before by_name", lambda c: (S.real_date(c), S.year_before(c), S.year_by_weekday(F.month(F.try_to_date(c, "yyyy-MM-dd")), F.dayofmonth(F.try_to_date(c, "yyyy-MM-dd")), F.lit("土"), F.lit(2026))), [("2026-08-22", (True, "2025-08-22", 2026)), ("2026-02-30", (False, "2025-02-30", 2026)), ("2026-08-21", (True, "2025-08-21", 2027)), ("2024-02-29", (True, "2023-02-29", 2026))])
cases("states", "status sticky is_blank", lambda t, d, b: (R.status(t, d, F.lit(TODAY)), R.sticky_status(b, R.status(t, d, F.lit(TODAY))), Q.blank(t)), [(("開催を中止しました", None, "published"), ("cancelled", "cancelled", False)), (("受付終了しました", None, "cancelled"), ("closed", "cancelled", False)), (("会{k}", "2026-08-01", "published"), ("closed", "closed", False)), (("会", "2026-09-01", "closed"), ("published", "closed", False)), ((" null ", None, ""), ("published", "published", True)), ((None, None, None), ("published", "published", True))])
cases("linked_data", "body", lambda t, d: (K.json_ld(t, d, F.lit(None).cast("string"), F.lit("会館"), F.lit("https://a.jp/")),), [(("会{k}</script>", "2026-09-01"), '{"@context":"https://schema.org","@type":"Event","name":"会{k}\\u003c/script>","startDate":"2026-09-01","endDate":"2026-09-01","location":{"@type":"Place","name":"会館"},"url":"https://a.jp/"}')])
cases("calendar_blocks", "uid day end_ title", lambda c: ICAL(c), [("BEGIN:VEVENT\r\nUID:u{k}\r\nDTSTART;VALUE=DATE:20260901\r\nDTEND;VALUE=DATE:20260903\r\nSUMMARY:a\\, b\r\n  c\r\nEND:VEVENT", ("u{k}", "2026-09-01", "2026-09-02", "a, b c"))])
cases("refresh_targets", "url", lambda c: (P.refresh_target(c),), [('<meta http-equiv="refresh" content="0; url=https://a.jp/{k}">', "https://a.jp/{k}"), ("<p>", None)])
cases("map_measures", "box lat_key ttl scale", lambda a, b, d: (Q.in_box(a.cast("double"), b.cast("double")), Q.coordinate_key(a.cast("double")), Q.ttl_seconds(d.cast("int")), F.round(Q.near_scale(d.cast("double")), 6)), [(("35.68123", "139.76712", "1"), (True, "35.681", 3600, 0.100329)), (("-0.0001", "139", "7"), (False, "0.000", 21600, 0.300986)), (("46.5", "154", "900"), (True, "46.500", 43200, 0.92)), (("46.6", "154", "0"), (False, "46.600", 3600, 0.013796))])
cases("row_errors", "names", lambda i, p, d, e, t, s, o: (F.array_join(Q.errors({"id": i, "pref": p, "date": d, "endDate": e, "title": t, "status": s, "deadlineDate": F.lit(""), "office": o, "latitude": F.lit(35.0), "longitude": F.lit(139.0), "accuracy": F.lit("venue")}, F.lit("tokyo")), ","),), [
    (("ev{k}", "tokyo", "2026-09-01", "", "会", "published", ""), ""), (("", "osaka", "2026-02-30", "2026-01-01", " ", "gone", "東京"), "id,pref,date,end_before_date,title,status,office"), (("manual-1", "tokyo", "2026-09-02", "2026-09-01", "会", None, "a-1"), "manual_id,end_before_date"), ((None, None, None, "x", None, "", ""), "id,pref,date,end_date,title")])
cases("row_warnings", "names", lambda t, p, u, tm, s, d: (F.array_join(Q.warnings({"title": t, "place": p, "notes": F.lit(""), "url": u, "time": tm, "deadline": F.lit(None).cast("string"), "address": F.lit(None).cast("string"), "status": s, "statusReason": F.lit(""), "deadlineDate": d, "date": F.lit("2026-09-01"), "endDate": F.lit(""), "source_type": F.lit("html")}, F.lit(TODAY)), ","),), [
    (("第{k}回説明会", "会館", "https://a.jp/", "10:00", "published", ""), ""), (("海上自衛隊", " ", "a.jp", "10時", "closed", "2026-09-02"), "junk_title,url,no_place,time_form,no_reason,deadline_after"), (("福利厚生資料のページ", "null", "", "", "", ""), "document,literal_null"), (("説明会", "〒123 会館", "", "", "", "2026-08-31"), "address_in_place")])
cases("parser_health", "failed", lambda c, n: ((n.cast("int") == 0) & (D.future_marks(c, F.lit(TODAY)) >= 2),), [(("9月1日と9月2日", "0"), True), (("9月1日と9月2日", "3"), False), (("9月1日だけ{k}", "0"), False), ((None, "0"), False)])
cases("edit_logs", "log kept public", lambda a, b: (F.array_join(Q.log_with(F.array(a, a, a), b, 3), ","), F.array_join(F.transform(Q.removed_item(F.array(F.struct(a.alias("id"), b.alias("v")), F.struct(b.alias("id"), a.alias("v"))), a), lambda x: x["v"]), ","), F.array_join(F.map_keys(Q.without_internal(F.create_map(F.concat(F.lit("__"), a), b, b, a))), ",")), [(("a{k}", "b"), ("b,a{k},a{k}", "a{k}", "b"))])


def S_views(agent: Column) -> Column:
    from eventloom.streaming.views import is_bot

    return is_bot(agent)


def ICAL(text: Column) -> tuple[Column, ...]:
    """The fields of a text's only event, through the reader of calendars."""
    one = P.event_fields(P.unfolded(text))
    return tuple(one[n] for n in ("uid", "date", "endDate", "title"))
