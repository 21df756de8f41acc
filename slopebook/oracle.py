"""DuckDB oracle SQL for the registered queries.

Written directly from the reference's semantics (the SQL functions and the
page scripts), over the same fixture derivations as the Spark side.  DuckDB
computes range containment, correlated aggregates and ordered string
aggregation its own way, so agreement is a real cross-check.
"""

from __future__ import annotations

from slopebook.sources.fixtures import HOOK_PARTS, SITE_PARTS, hook_sql, site_sql
from slopebook.sources.fixtures import with_fixtures as W

ORACLE: dict[str, str] = {}

ACTIVE = "('pending', 'confirmed')"

_OCC_ALL = """
, occ_r as (
  select id, shop_id, case when eve_pickup then rental_date - 1 else rental_date end as s,
         coalesce(return_date, rental_date) as e
  from fx_reservations where status in ('pending', 'confirmed'))
, occ_m as (
  select reservation_id, board_type as category, count(*) as n from fx_members
  where board_type in ('ski', 'snowboard') group by 1, 2)
, occ_days as (
  select r.shop_id, m.category, m.n,
         unnest(generate_series(cast(r.s as timestamp), cast(r.e as timestamp), interval 1 day)) as ts
  from occ_r r join occ_m m on m.reservation_id = r.id)
, occ as (
  select shop_id, category, cast(ts as date) as day, cast(sum(n) as int) as used
  from occ_days group by 1, 2, 3)
"""

ORACLE["e3_daily_occupancy"] = W(_OCC_ALL + """
select shop_id, category, day, used from occ
""", "fx_reservations", "fx_members")

ORACLE["e2_availability_by_category"] = W(_OCC_ALL + """
, w as (
  select id as window_id, shop_id, rental_date as "start", return_date as "end",
         case when eve_pickup then rental_date - 1 else rental_date end as "from"
  from fx_reservations)
, stock as (
  select shop_id, category, cast(sum(total_quantity) as int) as total from fx_equipment
  where is_active and category in ('ski', 'snowboard') group by 1, 2)
, peak as (
  select w.window_id, o.category, max(o.used) as peak
  from w join occ o on o.shop_id = w.shop_id and o.day between w."from" and w."end"
  group by 1, 2)
select w.window_id, w.shop_id, s.category, cast(s.total - coalesce(p.peak, 0) as int) as remaining,
       cast(null as varchar) as error
from w join stock s on s.shop_id = w.shop_id
left join peak p on p.window_id = w.window_id and p.category = s.category
where not (w."start" is null or w."end" is null or w."end" < w."start")
union all
select window_id, shop_id, null, null, 'INVALID_DATES' from w
where w."start" is null or w."end" is null or w."end" < w."start"
""", "fx_reservations", "fx_members", "fx_equipment")

ORACLE["e1_availability_by_size"] = W("""
, asked as (select distinct shop_id, rental_date as date from fx_reservations)
select a.date, a.shop_id, e.id as equipment_item_id, e.category, e.size_label,
  cast(row_number() over (partition by a.shop_id, a.date order by e.category, e.size_label, e.id) as int) as position,
  cast(e.total_quantity - coalesce((
    select sum(ri.quantity) from fx_items ri join fx_reservations r on r.id = ri.reservation_id
    where ri.equipment_item_id = e.id and r.rental_date = a.date and r.status in ('pending', 'confirmed')
  ), 0) as int) as remaining
from asked a join fx_equipment e on e.shop_id = a.shop_id and e.is_active
where e.total_quantity - coalesce((
    select sum(ri.quantity) from fx_items ri join fx_reservations r on r.id = ri.reservation_id
    where ri.equipment_item_id = e.id and r.rental_date = a.date and r.status in ('pending', 'confirmed')
  ), 0) > 0
""", "fx_reservations", "fx_items", "fx_equipment")

# --- requests ---------------------------------------------------------------

_REQ = """
, per as (
  select reservation_id, count(*) as n,
         cast(count(*) filter (where not is_child) as int) as n_adults,
         cast(count(*) filter (where is_child) as int) as n_children,
         bool_or(board_type not in ('ski', 'snowboard', 'none')) as bad_type
  from fx_members group by 1)
, req as (
  select r.id as request_id, r.shop_id, r.created_at as requested_at, r.rental_date as "start",
         r.return_date as "end", r.customer_name as "name", r.customer_phone as phone,
         r.customer_email as email,
         cast(p.n_adults + case when r.id % 13 = 0 then 1 else 0 end as int) as adults,
         p.n_children as children, p.n, p.bad_type, r.eve_pickup, r.notes
  from fx_reservations r left join per p on p.reservation_id = r.id)
, e5 as (
  select request_id, case
    when "start" is null or "end" is null or "end" < "start" then 'INVALID_DATES'
    when "start" < date '2024-12-10' then 'DATE_IN_PAST'
    when datediff('day', "start", "end") > 30 then 'PERIOD_TOO_LONG'
    when "name" is null or length(trim("name")) = 0 or phone is null or length(trim(phone)) < 10
      then 'INVALID_CONTACT'
    when n is null or n = 0 or n > 20 then 'INVALID_MEMBERS'
    when coalesce(adults, 0) + coalesce(children, 0) <> n then 'MEMBER_COUNT_MISMATCH'
    when exists (select 1 from fx_closed_dates c where c.shop_id = req.shop_id and c.closed_date between "start" and "end")
      then 'SHOP_CLOSED_ON_DATE'
    when eve_pickup and "start" - 1 < date '2024-12-10' then 'EVE_IN_PAST'
    when eve_pickup and exists (select 1 from fx_closed_dates c where c.shop_id = req.shop_id and c.closed_date = "start" - 1)
      then 'EVE_CLOSED'
    when bad_type then 'INVALID_BOARD_TYPE'
  end as code from req)
"""

_REQ_FX = ("fx_reservations", "fx_members", "fx_closed_dates")

ORACLE["e5_validate_v2"] = W(_REQ + "select request_id, code from e5", *_REQ_FX)

ORACLE["e6_capacity_check"] = W(_REQ + _OCC_ALL + """
, valid as (select req.* from req join e5 using (request_id) where e5.code is null)
, need as (
  select reservation_id as request_id, board_type as category, cast(count(*) as int) as need
  from fx_members where board_type is distinct from 'none' group by 1, 2)
, cells0 as (
  select v.request_id, v.shop_id, n.category, n.need, g.ts
  from valid v join need n on n.request_id = v.request_id,
  lateral (select unnest(generate_series(
             cast(case when v.eve_pickup then v."start" - 1 else v."start" end as timestamp),
             cast(v."end" as timestamp), interval 1 day)) as ts) g)
, stock as (
  select shop_id, category, sum(total_quantity) as total from fx_equipment
  where is_active and category in ('ski', 'snowboard') group by 1, 2)
, fails as (
  select c.request_id, c.category, cast(c.ts as date) as day
  from cells0 c
  left join stock s on s.shop_id = c.shop_id and s.category = c.category
  left join occ o on o.shop_id = c.shop_id and o.category = c.category and o.day = cast(c.ts as date)
  where coalesce(o.used, 0) + c.need > coalesce(s.total, 0))
, first_fail as (
  select * from fails
  qualify row_number() over (partition by request_id order by category nulls last, day) = 1)
select v.request_id,
  case when f.day is not null then
    'OUT_OF_STOCK:' || coalesce(f.category, '<NULL>') || ':' || strftime(f.day, '%Y-%m-%d') end as code,
  f.category, f.day
from valid v left join first_fail f on f.request_id = v.request_id
""", *_REQ_FX, "fx_equipment")

_V1 = """
, n_items as (select reservation_id, count(*) as n from fx_items group by 1)
, rq as (
  select r.id as request_id, r.rental_date, case
    when r.rental_date is null or r.party_size is null or r.party_size <= 0 or p.n is null or p.n = 0
      then 'INVALID_INPUT'
    when r.rental_date < date '2024-12-10' then 'DATE_IN_PAST'
    when exists (select 1 from fx_closed_dates c where c.shop_id = r.shop_id and c.closed_date = r.rental_date) then 'SHOP_CLOSED_ON_DATE'
  end as req_code
  from fx_reservations r left join n_items p on p.reservation_id = r.id)
, lines as (
  select reservation_id as request_id, equipment_item_id, cast(equipment_item_id as varchar) as eid_text,
         quantity as qty,
         cast(row_number() over (partition by reservation_id order by equipment_item_id, quantity) as int)
           as item_pos
  from fx_items)
, booked as (
  select i.equipment_item_id, r.rental_date, sum(i.quantity) as booked
  from fx_items i join fx_reservations r on r.id = i.reservation_id
  where r.status in ('pending', 'confirmed') group by 1, 2)
"""


def _v1_oracle(qty_expr: str) -> str:
    return W(_V1 + f"""
, lines2 as (select *, {qty_expr} as qty_check from lines)
, li as (
  select l.request_id, l.eid_text, l.item_pos, case
    when l.qty is null or l.qty <= 0 then 'INVALID_QUANTITY'
    when e.id is null then 'EQUIPMENT_NOT_FOUND'
    when not e.is_active then 'EQUIPMENT_INACTIVE'
    when coalesce(b.booked, 0) + l.qty_check > e.total_quantity then 'OUT_OF_STOCK:' || l.eid_text
  end as code
  from lines2 l join rq on rq.request_id = l.request_id and rq.req_code is null
  left join fx_equipment e on e.id = l.equipment_item_id
  left join booked b on b.equipment_item_id = l.equipment_item_id and b.rental_date = rq.rental_date)
, first_fail as (
  select * from li where code is not null
  qualify row_number() over (partition by request_id order by eid_text, item_pos) = 1)
select rq.request_id, coalesce(rq.req_code, f.code) as code,
       case when rq.req_code is null then f.item_pos end as item_pos
from rq left join first_fail f on f.request_id = rq.request_id
""", "fx_reservations", "fx_items", "fx_closed_dates", "fx_equipment")


ORACLE["e4_validate_v1"] = _v1_oracle("qty")
ORACLE["e4_validate_v1_summed"] = _v1_oracle("sum(qty) over (partition by request_id, eid_text)")

ORACLE["e8_code_collisions"] = W("""
, codes as (select id, 'YR-' || upper(substr(sha256(cast(id as varchar)), 1, 6)) as reservation_code
            from fx_reservations)
select reservation_code, count(*) as n, min(id) as first_id from codes group by 1 having count(*) > 1
""", "fx_reservations")

ORACLE["e8_unique_codes"] = W("""
, codes as (select id, created_at, 'YR-' || upper(substr(sha256(cast(id as varchar)), 1, 6)) as c from fx_reservations)
, taken as (select distinct c from codes where created_at < timestamp '1998-01-01')
, ranked as (select id, c, row_number() over (partition by c order by created_at, id) - 1
    + case when c in (select c from taken) then 1 else 0 end as n
  from codes where created_at >= timestamp '1998-01-01')
select id as request_id, case when n = 0 then c else c || '-' || cast(id as varchar) end as reservation_code from ranked
""", "fx_reservations")

ORACLE["a8_reservation_rows"] = W(_REQ + """
select request_id as id, shop_id, 'YR-' || upper(substr(sha256(cast(request_id as varchar)), 1, 6))
         as reservation_code,
  "start" as rental_date, "end" as return_date, trim("name") as customer_name, trim(phone) as customer_phone,
  nullif(trim(coalesce(email, '')), '') as customer_email, cast(n as int) as party_size,
  coalesce(adults, 0) as adults, coalesce(children, 0) as children, notes, 'pending' as status,
  coalesce(eve_pickup, false) as eve_pickup, requested_at as created_at
from req
""", *_REQ_FX)

ORACLE["a8_item_rows"] = W("""
select i.reservation_id, cast(row_number() over (partition by i.reservation_id order by i.equipment_item_id, i.quantity) as int) as item_pos,
  i.equipment_item_id, i.quantity
from fx_items i join fx_reservations r on r.id = i.reservation_id
""", "fx_items", "fx_reservations")

ORACLE["a8_member_rows"] = W("""
select reservation_id, member_no, height_cm, cast(shoe_cm as varchar) as shoe_cm, board_type,
  coalesce(is_child, false) as is_child,
  age, gender, stance, nullif(trim(coalesce(nickname, '')), '') as nickname, set_type,
  array_to_string(addons, ',') as addons
from fx_members
""", "fx_members")

ORACLE["a8_member_rows_json"] = ORACLE["a8_member_rows"]

# --- lookup, cancel, status, pricing, notifications --------------------------

ORACLE["b6_lookup_keys"] = W("""
select lookup_id, upper(trim(code)) as code, trim(phone) as phone,
       regexp_replace(phone, '[^0-9]', '', 'g') as phone_digits
from fx_lookups
""", "fx_lookups")

ORACLE["e9_lookup_v1"] = W("""
, m as (
  select l.lookup_id, r.* from fx_lookups l
  join fx_reservations r on r.reservation_code = upper(trim(l.code)) and r.customer_phone = trim(l.phone))
, it as (
  select ri.reservation_id,
         list_sort(list(coalesce(cast(e.category as varchar), 'null') || ':' || coalesce(e.size_label, 'null')
                        || ':' || cast(ri.quantity as varchar))) as lines
  from fx_items ri left join fx_equipment e on e.id = ri.equipment_item_id
  group by 1)
select m.lookup_id, m.id as reservation_id, m.reservation_code, m.rental_date, m.customer_name, m.party_size,
       m.status, coalesce(array_to_string(it.lines, ';'), '') as items,
       cast(coalesce(len(it.lines), 0) as int) as n_items
from m left join it on it.reservation_id = m.id
""", "fx_lookups", "fx_reservations", "fx_items", "fx_equipment")

_MEMBER_TEXT = """concat_ws(':', coalesce(cast(member_no as varchar), 'null'), coalesce(cast(height_cm as varchar), 'null'),
  coalesce(cast(shoe_cm as varchar), 'null'), coalesce(board_type, 'null'), coalesce(cast(is_child as varchar), 'null'),
  coalesce(cast(age as varchar), 'null'), coalesce(gender, 'null'), coalesce(stance, 'null'),
  coalesce(nickname, 'null'), coalesce(set_type, 'null'), array_to_string(coalesce(addons, []), '+'))"""

ORACLE["e10_lookup_v2"] = W(f"""
, ms as (
  select reservation_id, string_agg({_MEMBER_TEXT}, '|' order by member_no) as members, count(*) as n
  from fx_members group by 1)
select l.lookup_id, r.reservation_code, r.status, r.rental_date, coalesce(r.return_date, r.rental_date) as return_date,
  case when r.id is not null then coalesce(r.eve_pickup, false) end as eve_pickup, r.customer_name, r.adults, r.children,
  case when r.id is not null then coalesce(ms.members, '') end as members,
  case when r.id is not null then cast(coalesce(ms.n, 0) as int) end as n_members
from fx_lookups l
left join fx_reservations r on r.reservation_code = upper(trim(l.code)) and r.customer_phone = trim(l.phone)
left join ms on ms.reservation_id = r.id
""", "fx_lookups", "fx_reservations", "fx_members")

_CANCEL = """
, m as (
  select c.request_id, c.requested_at, r.id as reservation_id, r.status as old_status
  from fx_cancel_requests c
  left join fx_reservations r on r.reservation_code = upper(trim(c.code)) and r.customer_phone = trim(c.phone))
, ranked as (
  select *, row_number() over (partition by reservation_id order by requested_at, request_id) as rn from m)
"""

ORACLE["e11_cancel_results"] = W(_CANCEL + """
select request_id, case when reservation_id is null then 'NOT_FOUND'
  when old_status <> 'cancelled' and rn = 1 then 'OK' else 'ALREADY_CANCELLED' end as result
from ranked
""", "fx_cancel_requests", "fx_reservations")

ORACLE["e11_cancel_reservations"] = W(_CANCEL + """
, won as (select reservation_id, requested_at from ranked
          where reservation_id is not null and old_status <> 'cancelled' and rn = 1)
select r.id, case when w.reservation_id is not null then 'cancelled' else r.status end as status,
  coalesce(w.requested_at, r.cancelled_at) as cancelled_at, coalesce(w.requested_at, r.updated_at) as updated_at
from fx_reservations r left join won w on w.reservation_id = r.id
""", "fx_cancel_requests", "fx_reservations")

ORACLE["e12_status_changes"] = W("""
, ev as (select * from fx_status_events where action in ('confirm', 'cancel'))
, c as (select reservation_id, ts, event_id from ev where action = 'cancel'
        qualify row_number() over (partition by reservation_id order by ts, event_id) = 1)
, k as (select reservation_id, ts, event_id from ev where action = 'confirm'
        qualify row_number() over (partition by reservation_id order by ts, event_id) = 1)
, j as (
  select r.*, c.ts as c_ts, c.event_id as c_id, k.ts as k_ts, k.event_id as k_id,
    (r.status <> 'cancelled' and c.ts is not null) as cancel_now,
    (r.status = 'pending' and k.ts is not null
       and (c.ts is null or k.ts < c.ts or (k.ts = c.ts and k.event_id < c.event_id))) as confirm_now
  from fx_reservations r left join c on c.reservation_id = r.id left join k on k.reservation_id = r.id)
select id, case when cancel_now then 'cancelled' when confirm_now then 'confirmed' else status end as status,
  case when cancel_now then c_ts else cancelled_at end as cancelled_at,
  case when cancel_now then c_ts when confirm_now then k_ts else updated_at end as updated_at
from j
""", "fx_status_events", "fx_reservations")

_PRICE = """
, pm as (
  select m.reservation_id, m.member_no, m.set_type, m.is_child, m.addons,
    datediff('day', r.rental_date, coalesce(r.return_date, r.rental_date)) + 1 as days,
    coalesce(list_sum(list_transform(m.addons, lambda k: case k when 'wear_top' then 2000 when 'wear_btm' then 2000
      when 'helmet' then 1000 when 'goggle' then 1000 when 'sled' then 500 when 'snowshoe' then 2000
      when 'harness' then 1500 else 0 end)), 0) as addon_sum
  from fx_members m join fx_reservations r on r.id = m.reservation_id)
, pp as (
  select reservation_id, member_no, cast(case
    when days is null or days < 1 then null
    when set_type = 'none' then case when len(addons) = 0 then null else addon_sum * days end
    when set_type in ('full', 'gliding') then
      (case when days <= 4 then
         case set_type when 'full' then (case when is_child then [4000, 7000, 9500, 12000]
                                              else [6500, 12000, 17000, 22000] end)[days]
                       else (case when is_child then [2500, 4000, 5000, 6000]
                                  else [3500, 6000, 8000, 10000] end)[days] end
       else
         case set_type when 'full' then (case when is_child then 12000 + (days - 4) * 3000
                                              else 22000 + (days - 4) * 5500 end)
                       else (case when is_child then 6000 + (days - 4) * 2000
                                  else 10000 + (days - 4) * 2500 end) end
       end) + addon_sum * days
  end as bigint) as price
  from pm)
"""

ORACLE["e13_price_members"] = W(_PRICE + "select reservation_id, member_no, price from pp",
                                "fx_members", "fx_reservations")

ORACLE["e13_price_reservations"] = W(_PRICE + """
select reservation_id, case when bool_and(price is not null) then cast(sum(price) as bigint) end as total,
       bool_and(price is not null) as all_priced
from pp group by 1
""", "fx_members", "fx_reservations")

_LINES = """
, lines as (
  select reservation_id, string_agg(
    concat(coalesce(cast(member_no as varchar), ''), '. ', case when is_child then '子供' else '大人' end,
      case when nickname is not null then '（' || nickname || '）' else '' end,
      ' ／ 身長', coalesce(cast(height_cm as varchar), ''), 'cm・靴', coalesce(cast(shoe_cm as varchar), ''), 'cm ／ ',
      case board_type when 'ski' then 'スキー' when 'snowboard' then 'スノーボード' else '板レンタルなし' end,
      case when set_type = 'gliding' then '・滑走セット' when set_type = 'full' then '・フルセット'
           when set_type = 'none' then '・セットなし' else '' end,
      case when addons is not null and len(addons) > 0 then '・追加(' || array_to_string(addons, '・') || ')'
           else '' end),
    '<br>' order by member_no) as html
  from fx_members group by 1)
"""

ORACLE["e14_member_lines"] = W(_LINES + "select reservation_id, html from lines", "fx_members")

_LAG_CHANGES = """
, ch as (
  select event_id, reservation_id,
    case when action = 'created' then 'insert' else 'update' end as op,
    case action when 'created' then 'pending' when 'confirm' then 'confirmed' else 'cancelled' end as new_status
  from fx_status_events)
, ch2 as (select *, lag(new_status) over (partition by reservation_id order by ts, event_id) as old_status
          from ch join fx_status_events using (event_id, reservation_id))"""

_OUTBOX_TAIL = """
, shops as (
  select distinct shop_id, 'Shop ' || cast(shop_id as varchar) as shop_name,
    '000-0000-' || lpad(cast(shop_id as varchar), 4, '0') as shop_phone, '8:00〜17:00' as shop_hours,
    case when shop_id % 5 = 0 then null else 'shop' || cast(shop_id as varchar) || '@example.com' end as shop_email
  from fx_reservations)
, j as (
  select ch2.event_id, ch2.op, ch2.old_status, ch2.new_status, r.*, s.shop_name, s.shop_phone, s.shop_hours,
    s.shop_email, coalesce(l.html, '') as mem,
    strftime(r.rental_date, '%Y/%m/%d') || case when r.return_date is not null and r.return_date <> r.rental_date
      then ' 〜 ' || strftime(r.return_date, '%Y/%m/%d') else '（日帰り）' end as period,
    case when r.eve_pickup then '<br>前日受け取り: 希望する（前日午後2時〜）' else '' end as eve,
    coalesce(cast(coalesce(r.adults, r.party_size) as varchar), '') as adults_t,
    case when coalesce(r.children, 0) > 0 then ' / 子供' || cast(r.children as varchar) || '名' else '' end as kids
  from ch2 join fx_reservations r on r.id = ch2.reservation_id
  left join shops s on s.shop_id = r.shop_id left join lines l on l.reservation_id = r.id)
select event_id, id as reservation_id, customer_email as recipient, 'customer_created' as kind,
  '【' || coalesce(shop_name, '') || '】ご予約を受け付けました (' || reservation_code || ')' as subject,
  concat('ご予約ありがとうございます。<br><br>予約番号: <b>', reservation_code, '</b><br>ご利用期間: ', period, eve,
    '<br>お名前: ', coalesce(customer_name, ''), ' 様<br>人数: 大人', adults_t, '名', kids,
    '<br><br>【ご利用者】<br>', mem, '<br><br>お支払いは当日ご来店時に現金でお願いします。<br>営業時間 ',
    coalesce(shop_hours, ''), '／お電話 ', coalesce(shop_phone, '')) as html
from j where op = 'insert' and customer_email is not null
union all
select event_id, id, shop_email, 'shop_created',
  '【新規予約】' || period || ' ' || coalesce(customer_name, '') || '様',
  concat('新規予約が入りました。<br><br>予約番号: ', reservation_code, '<br>ご利用期間: ', period, eve,
    '<br>お名前: ', coalesce(customer_name, ''), ' 様<br>電話: ', coalesce(customer_phone, ''),
    '<br>メール: ', coalesce(customer_email, '（未入力）'), '<br>人数: 大人', adults_t, '名', kids,
    '<br>ご要望: ', coalesce(notes, '（なし）'), '<br><br>【ご利用者】<br>', mem)
from j where op = 'insert' and shop_email is not null
union all
select event_id, id, customer_email, 'customer_cancelled',
  '【' || coalesce(shop_name, '') || '】ご予約をキャンセルしました (' || reservation_code || ')',
  '予約番号 ' || reservation_code || ' のご予約をキャンセルしました。またのご利用をお待ちしております。'
from j where op = 'update' and new_status = 'cancelled' and old_status is distinct from 'cancelled'
  and customer_email is not null
"""


def _outbox_sql(changes: str, *extra: str) -> str:
    return W(_LINES + changes + _OUTBOX_TAIL, "fx_members", "fx_status_events", "fx_reservations", *extra)


ORACLE["e15_notification_outbox"] = _outbox_sql(_LAG_CHANGES)


# --- table maintenance ------------------------------------------------------

ORACLE["a2_conform_legacy_reservations"] = W("""
select id, shop_id, reservation_code, rental_date, cast(null as date) as return_date, false as eve_pickup,
  customer_name, customer_phone, customer_email, party_size, cast(null as int) as adults,
  cast(null as int) as children, status, notes, created_at, updated_at, cancelled_at
from fx_reservations
""", "fx_reservations")

_AUDIT = """
select 'equipment_items' as table_name, 'pk_id' as constraint_name, cast(id as varchar) as key
  from {eq} group by id having count(*) > 1
union all select 'equipment_items', 'unique_category_size',
  concat_ws('|', cast(shop_id as varchar), category, size_label)
  from {eq} where shop_id is not null and category is not null and size_label is not null
  group by shop_id, category, size_label having count(*) > 1
union all select 'equipment_items', 'check_category', cast(id as varchar) from {eq}
  where not coalesce(category in ('ski', 'snowboard', 'boots'), false)
union all select 'equipment_items', 'check_total_quantity', cast(id as varchar) from {eq}
  where total_quantity < 0
union all select 'equipment_items', 'not_null', cast(id as varchar) from {eq}
  where size_label is null or total_quantity is null or is_active is null
union all select 'reservations', 'pk_id', cast(id as varchar) from {res} group by id having count(*) > 1
union all select 'reservations', 'unique_reservation_code', reservation_code from {res}
  group by reservation_code having count(*) > 1
union all select 'reservations', 'check_party_size', cast(id as varchar) from {res} res where party_size <= 0
union all select 'reservations', 'check_status', cast(id as varchar) from {res}
  where not coalesce(status in ('pending', 'confirmed', 'cancelled'), false)
union all select 'reservations', 'not_null', cast(id as varchar) from {res}
  where reservation_code is null or rental_date is null or customer_name is null or customer_phone is null
     or party_size is null or eve_pickup is null
union all select 'reservation_items', 'check_quantity', cast(reservation_id as varchar) from {items}
  where quantity <= 0
union all select 'reservation_items', 'fk_reservation', cast(reservation_id as varchar) from {items} i
  where not exists (select 1 from {res} res where res.id = i.reservation_id)
union all select 'reservation_items', 'fk_equipment', cast(equipment_item_id as varchar) from {items} i
  where not exists (select 1 from {eq} e where e.id = i.equipment_item_id)
union all select 'reservation_members', 'check_height', concat_ws('|', cast(reservation_id as varchar), cast(member_no as varchar))
  from {mem} where not (height_cm between 80 and 220)
union all select 'reservation_members', 'check_shoe', concat_ws('|', cast(reservation_id as varchar), cast(member_no as varchar))
  from {mem} where not (shoe_cm between 14 and 33)
union all select 'reservation_members', 'check_board_type',
  concat_ws('|', cast(reservation_id as varchar), cast(member_no as varchar))
  from {mem} where not coalesce(board_type in ('ski', 'snowboard', 'none'), false)
union all select 'reservation_members', 'fk_reservation', cast(reservation_id as varchar) from {mem} m
  where not exists (select 1 from {res} res where res.id = m.reservation_id)
union all select 'closed_dates', 'pk_closed_date', concat_ws('|', cast(shop_id as varchar), cast(closed_date as varchar)) from {closed}
  group by shop_id, closed_date having count(*) > 1
union all select 'reservation_members', 'not_null', concat_ws('|', cast(reservation_id as varchar), cast(member_no as varchar))
  from {mem} where member_no is null or height_cm is null or shoe_cm is null
"""

ORACLE["a3_constraint_audit"] = W(_REQ + """
, res as (
  select request_id as id, 'YR-' || upper(substr(sha256(cast(request_id as varchar)), 1, 6)) as reservation_code,
    "start" as rental_date, trim("name") as customer_name, trim(phone) as customer_phone,
    cast(n as int) as party_size, 'pending' as status, coalesce(eve_pickup, false) as eve_pickup
  from req)
, mem as (select reservation_id, member_no, height_cm, shoe_cm, board_type from fx_members)
""" + _AUDIT.format(eq="fx_equipment", res="res", items="fx_items", mem="mem", closed="fx_closed_dates"), *_REQ_FX, "fx_equipment", "fx_items")

#: The tables with defects planted by id, so that every constraint is broken somewhere.
ORACLE["a3_broken_audit"] = W("""
, eq_b as (select case when id % 31 = 0 then id - 1 else id end as id, shop_id,
    case when id % 37 = 0 then 'sled' else category end as category,
    case when id % 29 = 0 then 'dup' when id % 61 = 0 then null else size_label end as size_label,
    case when id % 41 = 0 then -1 when id % 43 = 0 then null else total_quantity end as total_quantity, is_active
  from fx_equipment)
, res_1 as (select id, case when id % 53 = 0 then 'YR-DUP' else reservation_code end as reservation_code, rental_date, customer_name,
    case when id % 61 = 0 then null else customer_phone end as customer_phone,
    case when id % 19 = 0 then 0 else party_size end as party_size,
    case when id % 23 = 0 then 'lost' when id % 59 = 0 then null else status end as status, eve_pickup from fx_reservations)
, res_b as (select * from res_1 union all select * from res_1 where id % 67 = 0)
, items_b as (select case when reservation_id % 73 = 0 then -reservation_id else reservation_id end as reservation_id,
    case when equipment_item_id % 79 = 0 then -equipment_item_id else equipment_item_id end as equipment_item_id,
    case when reservation_id % 71 = 0 then 0 else quantity end as quantity from fx_items)
, mem_b as (select case when reservation_id % 53 = 0 then -reservation_id else reservation_id end as reservation_id,
    case when reservation_id % 59 = 0 then null else member_no end as member_no,
    case when reservation_id % 31 = 0 then 300 when reservation_id % 37 = 0 then null else height_cm end as height_cm,
    case when reservation_id % 41 = 0 then 33.5 else shoe_cm end as shoe_cm,
    case when reservation_id % 43 = 0 then 'sled' when reservation_id % 47 = 0 then null else board_type end as board_type from fx_members)
, closed_b as (select shop_id, closed_date from fx_closed_dates union all select shop_id, closed_date from fx_closed_dates where day(closed_date) % 2 = 0)
""" + _AUDIT.format(eq="eq_b", res="res_b", items="items_b", mem="mem_b", closed="closed_b"),
    "fx_equipment", "fx_reservations", "fx_items", "fx_members", "fx_closed_dates")

ORACLE["a4_insert_ignore"] = W("""
, feed as (select feed_no, shop_id, category, trim(size_label) as size_label, total_quantity from fx_equipment_feed
           where trim(size_label) <> '' and total_quantity >= 0)
, firsts as (select * from feed qualify row_number() over (partition by shop_id, category, size_label order by feed_no) = 1)
select shop_id, category, size_label, total_quantity, 'existing' as source from fx_equipment
union all
select shop_id, category, size_label, total_quantity, 'inserted' from firsts f
where not exists (select 1 from fx_equipment e where e.shop_id = f.shop_id and e.category = f.category and e.size_label = f.size_label)
""", "fx_equipment", "fx_equipment_feed")

ORACLE["a5_insert_report"] = W("""
, f as (
  select feed_no, shop_id, category, trim(size_label) as size_label, total_quantity,
    case when trim(size_label) = '' then 'INVALID_SIZE'
         when total_quantity is null or total_quantity < 0 then 'INVALID_QUANTITY' end as inv
  from fx_equipment_feed)
, firsts as (select shop_id, category, size_label, min(feed_no) as fst from f where inv is null group by 1, 2, 3)
select f.feed_no, f.shop_id, f.category, f.size_label, case when inv is not null then inv
  when exists (select 1 from fx_equipment e where e.shop_id = f.shop_id and e.category = f.category and e.size_label = f.size_label)
    or f.feed_no <> fi.fst then 'DUPLICATE' else 'ACCEPTED' end as status
from f left join firsts fi on fi.shop_id = f.shop_id and fi.category = f.category and fi.size_label = f.size_label
""", "fx_equipment", "fx_equipment_feed")

ORACLE["a6_upsert_pages"] = W("""
select page_key, html, id as version_id from fx_pages
qualify row_number() over (partition by page_key order by case when id % 3 = 0 then 1 else 0 end desc, id desc) = 1
""", "fx_pages")

# Sequential fold (the stepper's own rule), independent of the Spark plan's closed form.
ORACLE["a9_equipment_changes"] = W("""
, per as (
  select equipment_item_id, list(delta order by change_no) as ds,
         sum(case when toggle then 1 else 0 end) as flips
  from fx_equipment_changes group by 1)
select e.id,
  cast(case when p.ds is null then e.total_quantity
    else list_reduce(list_prepend(e.total_quantity, p.ds),
                     lambda acc, d: case when d < 0 then greatest(acc - 1, 0) else acc + d end) end as int)
    as total_quantity,
  case when coalesce(p.flips, 0) % 2 = 1 then not e.is_active else e.is_active end as is_active
from fx_equipment e left join per p on p.equipment_item_id = e.id
""", "fx_equipment", "fx_equipment_changes")

ORACLE["a10_guarded_delete"] = W("""
, del as (select id from fx_equipment where not is_active
          union all select id + 1000000 from fx_equipment where id % 50 = 0)
select d.id, case when e.id is null then 'NOT_FOUND'
  when exists (select 1 from fx_items i where i.equipment_item_id = d.id) then 'REFUSED' else 'DELETED' end
  as result
from del d left join fx_equipment e on e.id = d.id
""", "fx_equipment", "fx_items")

ORACLE["a11_cascade_delete"] = W("""
select reservation_id, member_no from fx_members m
where not exists (select 1 from fx_reservations r where r.id = m.reservation_id and r.status = 'cancelled')
""", "fx_members", "fx_reservations")

ORACLE["a12_delete_closed_days"] = W("""
select shop_id, closed_date from fx_closed_dates where closed_date >= date '2024-12-10'
""", "fx_closed_dates")

ORACLE["a13_stamp_updated_at"] = W("""
select id, case when id in (select reservation_id from fx_status_events) then timestamp '2025-01-01 00:00:00'
  else updated_at end as updated_at
from fx_reservations
""", "fx_reservations", "fx_status_events")

# --- lists and texts --------------------------------------------------------

ORACLE["b1_inventory_list"] = W("""
select id, shop_id, cast(row_number() over (partition by shop_id order by category, size_label, id) as int) as position,
  category, size_label, total_quantity, is_active from fx_equipment
""", "fx_equipment")

ORACLE["b2_visible_anon_equipment"] = W("""
select id, category, size_label, total_quantity from fx_equipment where is_active = true
""", "fx_equipment")

ORACLE["b3_upcoming_closed"] = W("""
select shop_id, closed_date, cast(row_number() over (partition by shop_id order by closed_date) as int) as position from fx_closed_dates where closed_date >= date '2024-12-10'
""", "fx_closed_dates")

ORACLE["b5_day_list"] = W("""
select r.id, r.shop_id, cast(row_number() over (partition by r.shop_id order by r.rental_date, r.created_at, r.id) as int) as position,
  r.reservation_code, r.rental_date, r.customer_name, r.customer_phone, r.party_size, r.status, coalesce(nullif((
    select string_agg(coalesce(case e.category when 'ski' then 'スキー' when 'snowboard' then 'スノーボード'
        when 'boots' then 'ブーツ' else e.category end, '?') || ' ' || coalesce(e.size_label, '') || ' ×' || cast(i.quantity as varchar),
      '、' order by i.equipment_item_id, i.quantity)
    from fx_items i left join fx_equipment e on e.id = i.equipment_item_id where i.reservation_id = r.id), ''), '—') as items_text
from fx_reservations r where r.rental_date = date '2025-01-15'
""", "fx_reservations", "fx_items", "fx_equipment")

ORACLE["d11_list_count"] = W("""
select shop_id, count(*) as n_listed from fx_reservations
where ((rental_date <= date '2025-01-15' and return_date >= date '2025-01-15')
  or (eve_pickup and rental_date = date '2025-01-16')) and status in ('pending', 'confirmed') group by shop_id
""", "fx_reservations")

ORACLE["a11_cascade_parents_and_items"] = W("""
select 'reservations' as table_name, id, cast(null as int) as equipment_item_id from fx_reservations
where status is null or status <> 'cancelled'
union all
select 'reservation_items', i.reservation_id, i.equipment_item_id from fx_items i
where not exists (select 1 from fx_reservations r where r.id = i.reservation_id and r.status = 'cancelled')
""", "fx_reservations", "fx_items")

ORACLE["a5_closed_day_report"] = W("""
, feed as (select cast(o_orderkey as bigint) as feed_no, cast(o_custkey % 25 as int) as shop_id,
    case when o_orderkey % 13 <> 0 then cast(o_orderdate as date) end as closed_date from orders)
select feed_no, shop_id, closed_date, case when closed_date is null then 'INVALID_DATE'
  when exists (select 1 from fx_closed_dates c where c.shop_id = feed.shop_id and c.closed_date = feed.closed_date)
    or row_number() over (partition by shop_id, closed_date order by feed_no) > 1 then 'DUPLICATE' else 'ACCEPTED' end as status
from feed
""", "fx_closed_dates")

ORACLE["b7_version_by_id"] = W("""
select a.id, p.page_key, p.created_at from (select cast(page_id * 2 as bigint) as id from pages) a left join fx_pages p on p.id = a.id
""", "fx_pages")


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace(coalesce(cast({x} as varchar), ''), '&', '&amp;'), "
            f"'<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')")


def _staff_sql(where: str) -> str:
    set_l = ("case set_type when 'gliding' then '滑走セット' when 'full' then 'フルセット(ウェア付)' "
             "when 'none' then 'セットなし(単品のみ)' end")
    addon_l = ("case k when 'wear_top' then 'ウェア（上）' when 'wear_btm' then 'ウェア（下）' "
               "when 'helmet' then 'ヘルメット' when 'goggle' then 'ゴーグル' when 'sled' then 'ソリ' "
               "when 'snowshoe' then 'スノーシュー' when 'harness' then 'キッズ用ハーネス' end")
    stance_l = ("case stance when 'regular' then 'レギュラー(左足前)' when 'goofy' then 'グーフィー(右足前)' "
                "when 'unknown' then 'スタンス未定' end")
    board_l = ("case board_type when 'ski' then 'スキー' when 'snowboard' then 'スノーボード' "
               "when 'none' then '板レンタルなし' else board_type end")
    return W(_PRICE + f"""
, r as (select * from fx_reservations where {where})
, ml as (
  select m.reservation_id, m.member_no, p.price,
    '・<b>' || case when m.is_child then '子供' else '大人' end
      || case when coalesce(m.nickname, '') <> '' then '・' || {_esc('m.nickname')} else '' end
      || '</b>｜身長 ' || coalesce(cast(m.height_cm as varchar), 'null')
      || 'cm｜靴 ' || coalesce(regexp_replace(cast(m.shoe_cm as varchar), '\\.0$', ''), 'null') || 'cm｜'
      || {_esc(board_l)}
      || coalesce('｜' || nullif(array_to_string(list_filter([
           case when coalesce(m.set_type, '') <> '' then {_esc(f'coalesce({set_l}, set_type)')} end,
           case when len(m.addons) > 0 then '追加:' || array_to_string(list_transform(m.addons,
             lambda k: {_esc(f'coalesce({addon_l}, k)')}), '・') end,
           case when coalesce(m.gender, '') <> '' then
             {_esc("coalesce(case gender when 'male' then '男性' when 'female' then '女性' end, gender)")} end,
           case when m.age is not null then cast(m.age as varchar) || '歳' end,
           case when m.board_type = 'snowboard' and coalesce(m.stance, '') <> '' then
             {_esc(f'coalesce({stance_l}, stance)')} end
         ], lambda x: x is not null), '｜'), ''), '')
      || case when p.price is not null then '｜<b>¥' || format('{{:,}}', p.price) || '</b>' else '' end as line
  from fx_members m join r on r.id = m.reservation_id
  join pp p on p.reservation_id = m.reservation_id and p.member_no = m.member_no)
, ma as (
  select reservation_id, count(*) as n, bool_and(price is not null) as all_set, sum(price) as total,
    string_agg(line, chr(10) order by member_no) as lines
  from ml group by 1)
, ia as (
  select i.reservation_id, string_agg(
    coalesce(case e.category when 'ski' then 'スキー' when 'snowboard' then 'スノーボード' when 'boots' then 'ブーツ'
             else e.category end, '?') || ' ' || coalesce(e.size_label, '') || ' ×' || cast(i.quantity as varchar),
    '、' order by i.equipment_item_id, i.quantity) as items
  from fx_items i join r on r.id = i.reservation_id left join fx_equipment e on e.id = i.equipment_item_id
  group by 1)
select r.id, r.shop_id, cast(row_number() over (partition by r.shop_id order by r.rental_date desc, r.created_at desc, r.id) as int)
    as position, r.reservation_code, r.rental_date, r.return_date, r.status,
  {_esc('r.customer_name')} || ' 様' as name_text,
  case when r.rental_date = coalesce(r.return_date, r.rental_date)
    then strftime(r.rental_date, '%Y-%m-%d') || '（日帰り）'
    else strftime(r.rental_date, '%Y-%m-%d') || ' 〜 ' || strftime(r.return_date, '%Y-%m-%d') || '（'
      || cast(datediff('day', r.rental_date, r.return_date) + 1 as varchar) || '日間）' end as period_text,
  case when r.adults is not null then '大人' || cast(r.adults as varchar) || '名'
      || case when coalesce(r.children, 0) <> 0 then ' / 子供' || cast(r.children as varchar) || '名' else '' end
    else coalesce(cast(r.party_size as varchar), 'null') || '名' end as party_text,
  case r.status when 'pending' then '受付中' when 'confirmed' then '確定' when 'cancelled' then 'キャンセル' end
    as status_label,
  r.eve_pickup as eve_badge, cast(coalesce(ma.n, 0) as int) as n_members,
  case when coalesce(ma.n, 0) > 0 then 'ご利用者（' || cast(ma.n as varchar) || '名）' || ma.lines
      || chr(10) || '合計（目安・現金）：' || case when ma.all_set then '¥' || format('{{:,}}', ma.total) else '—' end
    else '用具: ' || coalesce(nullif(ia.items, ''), '—') end as detail,
  case when coalesce(r.notes, '') <> '' then 'ご要望: ' || {_esc('r.notes')} end as notes_text,
  r.status = 'pending' as can_confirm, r.status <> 'cancelled' as can_cancel
from r left join ma on ma.reservation_id = r.id left join ia on ia.reservation_id = r.id
""", "fx_members", "fx_reservations", "fx_items", "fx_equipment")


ORACLE["b4_staff_list"] = _staff_sql(
    "((rental_date <= date '2025-01-15' and return_date >= date '2025-01-15') "
    "or (eve_pickup and rental_date = date '2025-01-16')) and status in ('pending', 'confirmed')")
ORACLE["b4_staff_list_all"] = _staff_sql("true")

ORACLE["e17_reject_messages"] = W(_REQ + """
select request_id, code, case
  when contains(code, 'OUT_OF_STOCK') then 'ご希望の期間・用具は満数になりました。日程を変えるか、お電話でご相談ください。'
  when contains(code, 'EVE_CLOSED') then '前日は休業日のため、前日受け取りはご利用いただけません。当日受け取りでご予約いただくか、お電話でご相談ください。'
  when contains(code, 'EVE_IN_PAST') then '前日受け取りができない日程です（前日がすでに過去の日付になっています）。開始日を1日後にずらしてください。'
  when contains(code, 'SHOP_CLOSED_ON_DATE') then '期間内に休業日が含まれています。別の日をお選びください。'
  when contains(code, 'DATE_IN_PAST') then '過去の日付は予約できません。'
  when contains(code, 'INVALID_DATES') then '利用日の指定が正しくありません。開始日と返却日をご確認ください。'
  when contains(code, 'PERIOD_TOO_LONG') then 'レンタル期間が長すぎます。30日以内でお選びください。'
  when contains(code, 'INVALID_CONTACT') then 'お名前と、当日つながる電話番号（10桁以上）をご入力ください。'
  when contains(code, 'MEMBER_COUNT_MISMATCH') then '人数と、入力された利用者の数が一致していません。'
  when contains(code, 'INVALID_MEMBERS') or contains(code, 'INVALID_BOARD_TYPE') then '利用者の情報をご確認ください。'
  when contains(code, 'INVALID_QUANTITY') then '数量の指定が正しくありません。'
  when contains(code, 'INVALID_INPUT') then '入力内容を確認してください。'
  when contains(code, 'EQUIPMENT_NOT_FOUND') or contains(code, 'EQUIPMENT_INACTIVE') then '選択した用具は現在ご利用いただけません。'
  when contains(code, 'ALREADY_CANCELLED') then 'この予約はすでにキャンセル済みです。'
  when contains(code, 'NOT_FOUND') then '予約が見つかりませんでした。予約番号と電話番号をご確認ください。'
  else '通信エラーが発生しました。時間をおいて再度お試しください。' end as message
from e5 where code is not null
""", *_REQ_FX)

# --- pages ------------------------------------------------------------------

ORACLE["e18_publish_pages"] = W("""
select page_key, id as version_id, created_at as updated_at, html, css from fx_pages
qualify row_number() over (partition by page_key order by id desc) = 1
""", "fx_pages")

ORACLE["e19_latest_versions"] = W("""
select page_key, id, created_at,
  cast(row_number() over (partition by page_key order by created_at desc, id desc) as int) as rank
from fx_pages qualify rank <= 20
""", "fx_pages")

ORACLE["e20_restore_version"] = W("""
, ch as (
  select page_key, id as version_id, created_at as updated_at from fx_pages
  union all
  select page_key, id + 1000000, created_at + interval 1 day from fx_pages where id % 7 = 0)
select page_key, version_id, updated_at from ch
qualify row_number() over (partition by page_key order by version_id desc) = 1
""", "fx_pages")

ORACLE["b7_page_by_key"] = W("""
, cur as (select page_key, id as version_id from fx_pages
          qualify row_number() over (partition by page_key order by id desc) = 1)
, k as (select distinct 'page-' || cast(page_id % 50 as varchar) as page_key from pages)
select k.page_key, cur.version_id from k left join cur on cur.page_key = k.page_key
""", "fx_pages")


def _b8() -> str:
    from slopebook.operators.pages import ABSOLUTE, FIXED_WIDTH
    return W(f"""
select id, case when coalesce(html, '') = '' then 'unusable'
  when regexp_matches(coalesce(html, ''), '{FIXED_WIDTH}') or regexp_matches(coalesce(css, ''), '{FIXED_WIDTH}')
    or regexp_matches(coalesce(html, ''), '{ABSOLUTE}') then 'fixed_wide' else 'fluid' end as layout
from fx_pages
""", "fx_pages")


ORACLE["b8_layout_class"] = _b8()


def _e24() -> str:
    import re as _re

    from slopebook.operators.pages import default_rewrite_rules
    from slopebook.registry import REWRITE_RULES
    steps, prev = [], "s0"
    # Rules for elements of a class find no such element in these pages; the site pages below have them.
    plain = [r for r in default_rewrite_rules(**REWRITE_RULES) if len(r) == 4]
    for i, (_n, cond, pat, rep) in enumerate(plain, start=1):
        q = lambda x: x.replace("'", "''")
        duck_rep = _re.sub(r"\$(\d)", r"\\\1", rep)
        fire = f"(regexp_matches(html, '{q(cond)}') and regexp_matches(html, '{q(pat)}'))"
        steps.append(f", s{i} as (select id, case when {fire} then regexp_replace(html, '{q(pat)}', "
                     f"'{q(duck_rep)}', 'g') else html end as html, "
                     f"n + case when {fire} then 1 else 0 end as n from {prev})")
        prev = f"s{i}"
    body = ", s0 as (select id, html, 0 as n from fx_pages)\n" + "\n".join(steps)
    return W(body + f"\nselect id, html, cast(n as int) as n_rules_hit from {prev}", "fx_pages")


ORACLE["e24_rewrite_html"] = _e24()

# --- site pages: the expected page is the template with some parts replaced ----------

_INNER = list(SITE_PARTS)[list(SITE_PARTS).index("root") + 1:list(SITE_PARTS).index("end_root")]


def _site(expr: str, name: str, empty: str = "''", more: str = "") -> str:
    return (f"select cast(o_orderkey as bigint) as id, case when o_orderkey % 17 = 0 then {empty} else {expr} end as {name}"
            f"{more} from orders")


ORACLE["b8_site_layout"] = _site("case when o_orderkey % 3 = 0 then 'fixed_wide' else 'fluid' end", "layout", "'unusable'")
ORACLE["e22_site_translate"] = _site(site_sql({
    "guest": "'Guest ' || (o_orderkey % 5 + 1) || ' (adult)'", "code": "'Booking code'", "image": "'<img alt=\"Ski\">'"}), "html")
ORACLE["e23_site_blocks"] = _site(site_sql({"ja": "''"}), "html")
ORACLE["e24_site_rewrite"] = _site(site_sql({
    "hours": "'<div class=\"access-row\">営業時間 8:00〜17:00</div>'", "link": "'<a href=\"tel:00000000000\">'", "handle": "'@new_shop'",
    "footer": "'<footer><a href=\"pages/faq.html\">よくある質問</a></footer></body></html>'"}), "html",
    more=", case when o_orderkey % 17 = 0 then 0 else 5 end as n_rules_hit")
# Nine rules find an element on every page, the booking title's on every second.
ORACLE["e24_site_elements"] = f"""
select cast(o_orderkey as bigint) as id, {hook_sql()} as html,
  cast(9 + case when (o_orderkey // {list(HOOK_PARTS).index("title") + 1}) % 2 = 0 then 1 else 0 end as int) as n_rules_hit from orders
"""
ORACLE["e25_site_root"] = _site(site_sql(parts=_INNER), "root_html", "null")
ORACLE["e25_site_style"] = _site("'.b{width:' || case when o_orderkey % 3 = 0 then '760px' else '90%' end || '}'", "style")
ORACLE["e21_site_texts"] = """
select id, translated, coalesce(case kind when 1 then '  Booking code ' else translated end, text) as display
from (select *, case kind when 0 then 'Guest ' || n || ' (child)' when 1 then 'Booking code' when 2 then '★Booking code ›'
        when 3 then 'Adult #' || n when 4 then strftime(o_orderdate, '%Y-%m-%d') || ' (day trip)' when 5 then 'Full Set・Ski' end as translated,
      case kind when 6 then 'plain ' || n when 7 then '不明な文' || n else '' end as text
  from (select cast(o_orderkey as bigint) as id, o_orderkey % 8 as kind, o_orderkey % 5 + 1 as n, o_orderdate from orders))
"""

ORACLE["e25_first_style"] = W("""
select id, coalesce(regexp_extract(html, '(?is)<style\\b[^>]*>(.*?)</style>', 1), '') as style from fx_pages
""", "fx_pages")

ORACLE["e27_version_nav"] = W("""
select page_key, id, lag(id) over (partition by page_key order by id) as prev_id,
  lead(id) over (partition by page_key order by id) as next_id
from fx_pages
""", "fx_pages")

# --- translation ----------------------------------------------------------------
# The documents table has no Japanese text, so only the "not Japanese -> no
# translation" path is reachable here; a Japanese row would surface as a
# mismatch ('UNCHECKED') instead of passing silently.  The Japanese paths are
# covered by hand-written cases in tests/test_translate.py.
ORACLE["e21_translate_documents"] = """
select doc_id,
  case when regexp_matches(text, '[\\x{3041}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}]') then 'UNCHECKED' end
    as translated,
  case when regexp_matches(text, '[\\x{3041}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}]') then 'UNCHECKED'
    else text end as display
from documents
"""

# --- status transitions and streams -----------------------------------------------

_TRANSITIONS = """
, c1 as (select reservation_id, ts as c_ts, event_id as c_id from fx_status_events where action = 'cancel'
         qualify row_number() over (partition by reservation_id order by ts, event_id) = 1)
, k1 as (select reservation_id, ts as k_ts, event_id as k_id from fx_status_events where action = 'confirm'
         qualify row_number() over (partition by reservation_id order by ts, event_id) = 1)
, t1 as (
  select e.*, r.status as base, c1.c_ts, c1.c_id, k1.k_ts, k1.k_id
  from fx_status_events e left join fx_reservations r on r.id = e.reservation_id
  left join c1 on c1.reservation_id = e.reservation_id left join k1 on k1.reservation_id = e.reservation_id)
, t2 as (
  select *,
    coalesce(base = 'pending' and k_ts is not null
             and (c_ts is null or k_ts < c_ts or (k_ts = c_ts and k_id < c_id)), false) as confirm_ok,
    coalesce(base <> 'cancelled' and c_ts is not null, false) as cancel_ok
  from t1)
, t3 as (
  select *,
    case when cancel_ok and (ts > c_ts or (ts = c_ts and event_id > c_id)) then 'cancelled'
         when confirm_ok and (ts > k_ts or (ts = k_ts and event_id > k_id)) then 'confirmed' else base end
      as old_status,
    (action = 'confirm' and confirm_ok and ts = k_ts and event_id = k_id)
      or (action = 'cancel' and cancel_ok and ts = c_ts and event_id = c_id) as applied
  from t2)
, tr as (
  select event_id, reservation_id, ts, action, old_status,
    case when applied and action = 'confirm' then 'confirmed' when applied and action = 'cancel' then 'cancelled'
         else old_status end as new_status,
    applied,
    case when action = 'confirm' then case when applied then 'OK' else 'NOT_PENDING' end
         when action = 'cancel' then case when old_status is null then 'NOT_FOUND' when applied then 'OK'
                                          else 'ALREADY_CANCELLED' end
         else 'NO_CHANGE' end as result
  from t3)
"""

ORACLE["e12_status_transitions"] = W(_TRANSITIONS + """
select event_id, reservation_id, ts, action, old_status, new_status, applied, result from tr
""", "fx_status_events", "fx_reservations")

# The stream must equal the batch transitions.
ORACLE["j2_status_stream"] = ORACLE["e12_status_transitions"]

ORACLE["j1_outbox_stream"] = _outbox_sql(_TRANSITIONS + """
, ch2 as (
  select event_id, reservation_id, 'insert' as op, cast(null as varchar) as old_status, new_status
  from tr where action = 'created'
  union all
  select event_id, reservation_id, 'update', old_status, new_status from tr where applied)""")

ORACLE["a1_scan_equipment"] = W("""
select id, shop_id, category, size_label, total_quantity, is_active, cast(null as varchar) as notes,
  cast(null as timestamp) as created_at, cast(null as timestamp) as updated_at
from fx_equipment
""", "fx_equipment")

ORACLE["a7_append_versions"] = W("select id, page_key, created_at from fx_pages", "fx_pages")
ORACLE["a7_stored_versions"] = ORACLE["a7_append_versions"]
ORACLE["e18_stored_pages"] = W("""
select page_key, id as version_id, created_at as updated_at, html, css from fx_pages
qualify row_number() over (partition by page_key order by case when id % 3 = 0 then 1 else 0 end desc, id desc) = 1
""", "fx_pages")

ORACLE["a3_site_audit"] = W("""
, v as (select case when id % 11 = 0 then id - 1 else id end as id, case when id % 13 <> 0 then page_key end as page_key,
    case when id % 7 <> 0 then html end as html, css, case when id % 17 <> 0 then project_data end as project_data from fx_pages)
, p as (select page_key, case when id % 5 <> 0 then html end as html from fx_pages where id < 60)
, s as (select cast(id % 25 as int) as shop_id, case when id % 9 = 0 then 2 else 1 end as id, id % 4 = 0 as no_time from fx_pages)
select 'business_settings' as table_name, 'pk_id' as constraint_name, concat_ws('|', cast(shop_id as varchar), cast(id as varchar)) as key
  from s group by shop_id, id having count(*) > 1
union all select 'business_settings', 'check_single_row', cast(shop_id as varchar) from s where id <> 1
union all select 'business_settings', 'not_null', cast(shop_id as varchar) from s where no_time
union all select 'site_pages', 'pk_page_key', page_key from p group by page_key having count(*) > 1
union all select 'site_pages', 'not_null', page_key from p where html is null
union all select 'site_page_versions', 'pk_id', cast(id as varchar) from v group by id having count(*) > 1
union all select 'site_page_versions', 'not_null', cast(id as varchar) from v where page_key is null or html is null or project_data is null
""", "fx_pages")

ORACLE["b2_visible_rows"] = W("""
, n as (select 'equipment_items' as table_name, 'anon' as role, count(*) as n from fx_equipment where is_active
  union all select 'equipment_items', 'staff', count(*) from fx_equipment
  union all select 'closed_dates', r, count(*) from fx_closed_dates, (values ('anon'), ('staff')) x(r) group by r
  union all select 'reservations', 'staff', count(*) from fx_reservations
  union all select 'reservation_items', 'staff', count(*) from fx_items
  union all select 'reservation_members', 'staff', count(*) from fx_members
  union all select 'site_pages', r, count(distinct page_key) from fx_pages, (values ('anon'), ('staff')) x(r) group by r
  union all select 'site_page_versions', 'staff', count(*) from fx_pages)
select table_name, role, n from n where n > 0
""", "fx_equipment", "fx_closed_dates", "fx_reservations", "fx_items", "fx_members", "fx_pages")

ORACLE["asset_names"] = """
select page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') as name from pages
"""

ORACLE["e16_lookup_card"] = W("""
, mrows as (
  select reservation_id, member_no,
    '利用者' || cast(row_number() over (partition by reservation_id order by member_no) as varchar) || '（'
      || case when is_child then 'お子様' else '大人' end || '）｜'
      || coalesce(cast(height_cm as varchar), 'null') || 'cm / '
      || coalesce(regexp_replace(cast(shoe_cm as varchar), '\\.0$', ''), 'null') || 'cm［'
      || coalesce(case board_type when 'ski' then 'スキー' when 'snowboard' then 'スノーボード'
                  when 'none' then '板のレンタルなし' else board_type end, 'undefined') || '］'
      || coalesce('｜' || nullif(array_to_string(list_filter([
           case when coalesce(gender, '') <> '' then
             coalesce(case gender when 'male' then '男性' when 'female' then '女性' end, gender) end,
           case when coalesce(age, 0) <> 0 then cast(age as varchar) || '歳' end,
           case when board_type = 'snowboard' and coalesce(stance, '') <> '' then
             coalesce(case stance when 'regular' then 'レギュラー' when 'goofy' then 'グーフィー'
                      when 'unknown' then 'スタンス未定' end, stance) end
         ], lambda x: x is not null), ' / '), ''), '') as row
  from fx_members)
, ms as (select reservation_id, string_agg(row, chr(10) order by member_no) as members_text from mrows group by 1)
select l.lookup_id, r.reservation_code,
  coalesce(case r.status when 'pending' then '予約受付中' when 'confirmed' then '予約確定'
           when 'cancelled' then 'キャンセル済み' end, r.status) as status_label,
  case when r.rental_date = coalesce(r.return_date, r.rental_date)
    then strftime(r.rental_date, '%Y-%m-%d') || '（日帰り）'
    else strftime(r.rental_date, '%Y-%m-%d') || ' 〜 ' || strftime(r.return_date, '%Y-%m-%d') || '（'
      || cast(datediff('day', r.rental_date, r.return_date) + 1 as varchar) || '日間）' end as period_text,
  case when r.eve_pickup then '前日受け取り: 希望する' end as eve_text,
  replace(replace(replace(replace(coalesce(r.customer_name, ''), '&', '&amp;'), '"', '&quot;'), '<', '&lt;'),
          '>', '&gt;') || ' 様' as name_text,
  case when r.adults is not null then '大人 ' || cast(r.adults as varchar) || '名'
    || case when coalesce(r.children, 0) <> 0 then ' / 子供 ' || cast(r.children as varchar) || '名' else '' end
    else '' end as party_text,
  coalesce(ms.members_text, '') as members_text,
  r.status <> 'cancelled' as can_cancel
from fx_lookups l
join fx_reservations r on r.reservation_code = upper(trim(l.code)) and r.customer_phone = trim(l.phone)
left join ms on ms.reservation_id = r.id
""", "fx_lookups", "fx_reservations", "fx_members")
