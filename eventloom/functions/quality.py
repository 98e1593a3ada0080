"""Row tests: identity, scope, retention, errors and warnings of a row, small measures. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions.rules import CANCEL_MASKS, CANCEL_SURE, mask_then_confirm
from eventloom.functions.scalars import blank_to_null, compare_url, dedup_key, real_date
from eventloom.functions.titles import document, far_future, junk_title

# States that may be shown, and all; roles bound to one office; box of the country; kinds of coordinates.
PUBLIC = ("published", "closed", "cancelled", "postponed")
STATES = (*PUBLIC, "draft")
OFFICE_ROLES = ("office_editor", "office_manager")
BOX = (20.0, 46.5, 122.0, 154.0)
ACCURACIES = ("address", "venue", "municipality", "prefecture", "manual")
# Words by which a source says that a field is gone; words of notes whose loss is told.
REMOVALS = {
    "time": "時間未定|時間は未定|時間調整中|時刻未定",
    "place": "会場未定|場所未定|会場調整中|場所調整中",
    "deadline": "締切なし|締め切りなし|締切りなし|応募不要|申込不要|申し込み不要|予約不要|申込み不要",
    "deadlineDate": "締切なし|締め切りなし|締切りなし|応募不要|申込不要|申し込み不要|予約不要|申込み不要",
    "ageRequirement": "年齢不問|年齢制限なし|年齢制限はありません|どなたでも|対象制限なし",
}
KEYWORDS = ("抽選", "予約", "要申込", "事前申込", "日本国籍", "保護者", "定員", "締切", "無料", "持ち物", "受付")


def blank(c: Column) -> Column:
    return blank_to_null(c).isNull()


def effective_end(end: Column, date: Column) -> Column:
    return F.coalesce(F.nullif(end, F.lit("")), date, F.lit(""))


def ended(end: Column, date: Column, today: Column) -> Column:
    last = effective_end(end, date)
    return (last != "") & (last < today)


def past(end: Column, date: Column, today: Column) -> Column:
    """Ended by a day that exists."""
    return real_date(effective_end(end, date)) & real_date(today) & (effective_end(end, date) < today)


def retained(end: Column, date: Column, today: Column, days: int = 7) -> Column:
    return effective_end(end, date) >= F.date_format(F.date_sub(today.cast("date"), days), "yyyy-MM-dd")


def past_match(row: dict[str, Column], **asked: str) -> Column:
    """Rows within from/to by their last day, of a status, pref and office, with a text in title or place; blanks ask nothing."""
    last = effective_end(row["endDate"], row["date"])
    hit = F.lit(True)
    if asked.get("from_"):
        hit &= last >= asked["from_"]
    if asked.get("to"):
        hit &= last <= asked["to"]
    for k in ("status", "pref", "office"):
        if asked.get(k):
            hit &= F.coalesce(row[k], F.lit("")) == asked[k]
    if asked.get("q"):
        hit &= F.lower(F.concat_ws(" ", F.coalesce(row["title"], F.lit("")), F.coalesce(row["place"], F.lit("")))).contains(asked["q"].lower())
    return hit


def checked_query(q: dict[str, Column], most: int = 100, usual: int = 50) -> Column:
    """struct(error, limit, offset) of the text parameters from, to, status, limit, offset; error is null if all are sound."""
    has = lambda c: c.isNotNull() & (c != "")
    limit, offset = q["limit"].try_cast("int"), q["offset"].try_cast("int")
    error = (
        F.when(has(q["from"]) & ~real_date(q["from"]), "invalid from")
        .when(has(q["to"]) & ~real_date(q["to"]), "invalid to")
        .when(has(q["from"]) & has(q["to"]) & (q["from"] > q["to"]), "from after to")
        .when(has(q["status"]) & ~q["status"].isin(*STATES), "invalid status")
        .when(has(q["limit"]) & ~F.coalesce(limit.between(1, most), F.lit(False)), "invalid limit")
        .when(has(q["offset"]) & ~F.coalesce(offset >= 0, F.lit(False)), "invalid offset")
    )
    return F.struct(error.alias("error"), F.when(error.isNull(), F.coalesce(limit, F.lit(usual))).alias("limit"), F.when(error.isNull(), F.coalesce(offset, F.lit(0))).alias("offset"))


def in_scope(role: Column, organization: Column, own_office: Column, enabled: Column, pref: Column, office: Column) -> Column:
    """Whether an account may act on a row; denied unless a rule allows it. Office roles need an office on both sides."""
    national = (role == "national_admin") | (organization == "*")
    own = (organization == pref) & (~role.isin(*OFFICE_ROLES) | ((own_office == office) & (own_office != "")))
    return F.coalesce(enabled, F.lit(True)) & (F.coalesce(national, F.lit(False)) | F.coalesce((pref != "") & own, F.lit(False)))


def countable_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,119}$"), F.lit(False))


def same_source(a: Column, b: Column) -> Column:
    return (compare_url(a) != "") & (compare_url(a) == compare_url(b))


def same_event(prev: dict[str, Column], now: dict[str, Column]) -> Column:
    """One event in two snapshots: id, pref and date agree, and the source or the title's key."""
    key = lambda r: dedup_key(F.coalesce(r["title"], F.lit("")))
    titled = (key(prev) != "") & (key(prev) == key(now))
    return F.coalesce((prev["id"] == now["id"]) & (prev["pref"] == now["pref"]) & (prev["date"] == now["date"]) & (F.coalesce(same_source(prev["url"], now["url"]), F.lit(False)) | titled), F.lit(False))


def same_place(place: Column, address: Column, place2: Column, address2: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s　]", "")
    return (bare(place) == bare(place2)) & (bare(address) == bare(address2))


#: Columns in whose text a source says that a field is gone.
SAYS = ("title", "notes", "time", "place", "deadline", "ageRequirement")


def said(row: dict[str, Column]) -> Column:
    """The text of a row in which a removal may be said."""
    return F.concat_ws("\n", *[row[c] for c in SAYS if c in row])


def removed(field: str, text: Column, state: Column | None = None) -> Column:
    """Whether the source says that a field is gone, in its words or by a map of field states."""
    stated = F.lit(False) if state is None else F.coalesce(F.try_element_at(state, F.lit(field)) == "removed", F.lit(False))
    return stated | (F.coalesce(text.rlike(REMOVALS[field]), F.lit(False)) if field in REMOVALS else F.lit(False))


def loss_reason(same: Column, cancelled: Column, explicit: Column, moved: Column, changed: Column) -> Column:
    """Why a field was lost; only an extraction failure is to be made good."""
    return F.when(~same, "identity_mismatch").when(cancelled, "cancelled").when(explicit, "explicit_removal").when(moved, "place_changed").when(changed, "deadline_changed").otherwise("extraction_failure")


def notes_change(before: Column, now: Column) -> Column:
    """struct(lost, shrunk): keywords of which none is left, and whether 30 % of the length or less is."""
    had = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(before, k))
    left = F.exists(had, lambda k: F.contains(now, k))
    return F.struct(F.when(left, F.array().cast("array<string>")).otherwise(had).alias("lost"), (F.char_length(now) <= F.char_length(before) * 0.3).alias("shrunk"))


def cancelled_row(status: Column, *texts: Column) -> Column:
    return (F.coalesce(status, F.lit("")) == "cancelled") | mask_then_confirm(F.concat_ws("\n", *texts), CANCEL_MASKS, CANCEL_SURE)


def errors(row: dict[str, Column], key: Column) -> Column:
    """Names of the rules that stop a snapshot's publication, for one row stored under ``key``."""
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    lat, lon = row["latitude"], row["longitude"]
    placed = lat.isNotNull() | lon.isNotNull()
    rules = {
        "id": absent(row["id"]),
        "manual_id": row["id"].startswith("manual-"),
        "pref": ~row["pref"].eqNullSafe(key),
        "date": ~real_date(row["date"]),
        "end_date": ~absent(row["endDate"]) & ~real_date(row["endDate"]),
        "end_before_date": ~absent(row["endDate"]) & real_date(row["endDate"]) & (row["endDate"] < row["date"]),
        "title": F.trim(F.coalesce(row["title"], F.lit(""))) == "",
        "status": ~absent(row["status"]) & ~row["status"].isin(*STATES),
        "deadline_date": ~absent(row["deadlineDate"]) & ~real_date(row["deadlineDate"]),
        "office": ~absent(row["office"]) & ~row["office"].rlike("^[a-z0-9][a-z0-9-]{0,39}$"),
        "coordinates": placed & ~F.coalesce(lat.between(BOX[0], BOX[1]) & lon.between(BOX[2], BOX[3]), F.lit(False)),
        "accuracy": ~absent(row["accuracy"]) & ~row["accuracy"].isin(*ACCURACIES),
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull())


def warnings(row: dict[str, Column], today: Column) -> Column:
    """Names of the rules that only tell, for one row."""
    text = lambda k: F.coalesce(row[k], F.lit(""))
    last = effective_end(row["endDate"], row["date"])
    literal = [row[k].rlike(r"(?i)^\s*(null|undefined)\s*$") for k in ("place", "time", "deadline", "address", "notes")]
    stated = F.lit(False)
    for c in literal:
        stated = stated | F.coalesce(c, F.lit(False))
    rules = {
        "junk_title": (F.trim(text("title")) != "") & junk_title(F.trim(row["title"])),
        "long_title": F.char_length(row["title"]) > 80,
        "document": document(row["title"], row["place"], row["notes"], row["url"]),
        "far_future": far_future(row["title"], row["url"], text("source_type"), row["date"], today).isNotNull(),
        "url": (text("url") != "") & ~row["url"].rlike("(?i)^https?://"),
        "no_place": F.trim(text("place")) == "",
        "stub": text("source_type") == "office_notice",
        "literal_null": stated,
        "time_form": row["time"].rlike("時|分|から|午前|午後"),
        "address_in_place": row["place"].rlike(r"〒\s*\d|,\s*日本[、,]"),
        "no_reason": row["status"].isin("cancelled", "closed") & (F.trim(text("statusReason")) == ""),
        "deadline_after": real_date(row["deadlineDate"]) & (row["deadlineDate"] > last),
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull())


def drop_level(before: Column, now: Column) -> Column:
    """'error' from a loss of 35 % of all rows on, 'warning' from 20 %."""
    lost = (before - now) / before
    return F.when(before > 0, F.when(lost >= 0.35, "error").when(lost >= 0.20, "warning"))


def loose_json(c: Column) -> Column:
    """The outermost braces of a text as a variant, null if they hold no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


def without_internal(c: Column) -> Column:
    """A map without the keys that begin with two underscores."""
    return F.map_filter(c, lambda k, _: ~k.startswith("__"))


def log_with(log: Column, entry: Column, most: int = 50) -> Column:
    """The newest entry first, at most ``most``."""
    return F.slice(F.concat(F.array(entry), F.coalesce(log, F.array())), 1, most)


def replaced(items: Column, id_: Column, value: Column) -> Column:
    """An array of structs in which the item of that id is another."""
    return F.transform(items, lambda x: F.when(x["id"] == id_, value).otherwise(x))


def removed_item(items: Column, id_: Column) -> Column:
    return F.filter(items, lambda x: ~x["id"].eqNullSafe(id_))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def coordinate_key(c: Column) -> Column:
    """Three decimals; minus zero is zero."""
    t = F.format_string("%.3f", F.round(c.cast("decimal(18,9)"), 3).cast("double"))
    return F.when(t == "-0.000", "0.000").otherwise(t)


def ttl_seconds(days: Column) -> Column:
    return F.when(days <= 2, 3600).when(days <= 7, 6 * 3600).otherwise(12 * 3600)


def near_scale(km: Column, most: float = 1000.0) -> Column:
    """A distance on a logarithmic scale up to 0.92."""
    return F.least(F.lit(0.92), F.ln(F.greatest(km, F.lit(0.1)) + 1) / F.ln(F.lit(most + 1)))


def presence(ago: Column, online: int = 120, away: int = 600) -> Column:
    """online, away or offline by the seconds since somebody was last seen; a time ahead is a clock's error."""
    return F.when(ago.isNull(), "offline").when(ago <= online, "online").when(ago <= away, "away").otherwise("offline")
