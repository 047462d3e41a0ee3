"""Plain SQL statements of the registered queries, for an independent engine.

The statements define each operator over single games and persons (windows over
all games, joins over all pairs), not the way the library computes it.
"""

from __future__ import annotations

import re

_GAMES = r"""
games0 AS (
  select cast(floor(c.c_custkey / 150) as int) as org_id, o.o_orderkey as game_id,
    cast(DATE '2000-01-03' + cast(7 * ((o.o_orderkey * 11) % 161)
      + case when o.o_orderkey % 5 = 0 then (o.o_orderkey * 3) % 7 else 5 + o.o_orderkey % 2 end as int)
      * interval '1' day as date) as game_date,
    cast(600 + 15 * ((o.o_orderkey * 7) % 41) as int) as start_min,
    o.o_orderstatus <> 'F' as is_home,
    cast((o.o_orderkey * 13) % 31 as int) as team_idx
  from orders o join customer c on o.o_custkey = c.c_custkey),
games1 AS (
  select g.*, t.team_code, t.has_cash, t.has_wiper, t.parent_duty,
    'SC Example ' || g.org_id as club, regexp_extract(t.team_code, '(\d)$', 1) as team_nr,
    regexp_replace(regexp_replace(t.team_code, '\d$', ''), '^([mwg])', '\1J') || '-KL' as league,
    case when g.is_home then 'H' || g.org_id else 'X' end as venue
  from games0 g join dim_team t using (team_idx)),
games2 AS (
  select *, case when team_nr > '1' then club || ' ' || team_nr else club end as own_side,
    case when is_home then start_min - 60 else start_min - 120 end as block_from,
    case when is_home then start_min + 120 else start_min + 180 end as block_to
  from games1),
games AS (
  select *, case when is_home then own_side else 'TV Other' end as home,
    case when is_home then 'TV Other' else own_side end as away
  from games2),
home AS (select *, game_date as shift_date from games where is_home),
persons0 AS (
  select cast(floor(c_custkey / 150) as int) as org_id, c_custkey as person_id, c_name as name,
    c_custkey % 20 = 0 as is_supervisor, cast((c_custkey * 7) % 19 as int) as team_idx,
    case when c_custkey % 11 = 0 then cast((c_custkey * 5) % 31 as int) end as trains_team_idx,
    cast(floor(greatest(c_acctbal, 0) / 20) as int) as worked_min
  from customer),
persons AS (
  select p.org_id, p.person_id, p.name, case when p.is_supervisor then 'Aufsicht' else t.team_code end as team_code,
    p.worked_min, p.is_supervisor, c.team_code as trains_team
  from persons0 p join dim_team t on t.team_idx = p.team_idx
  left join dim_team c on c.team_idx = p.trains_team_idx)
"""

_SHIFTS = r"""
first_games AS (
  select * from (select *, row_number() over (partition by org_id, shift_date order by start_min, game_id) as rn
    from home) where rn = 1),
env AS (
  select h.org_id, h.shift_date,
    cast(min(h.start_min) - max(case when f.team_code = 'F1' then 30 else 0 end) as int) as start_min,
    max(h.start_min) as end_min
  from home h join first_games f on f.org_id = h.org_id and f.shift_date = h.shift_date
  group by h.org_id, h.shift_date),
chain AS (
  select org_id, shift_date, team_code, start_min as kick_off, game_id,
    lag(start_min) over d as before, lead(start_min) over d as after,
    row_number() over (partition by org_id, shift_date, team_code order by start_min desc, game_id desc) as last_first
  from home where parent_duty window d as (partition by org_id, shift_date order by start_min, game_id)),
parent_sales AS (
  select org_id, shift_date, team_code as parents_of,
    case when before is null then kick_off - 60 else kick_off - 30 end as start_min,
    coalesce(after - 30, kick_off + 60) as end_min
  from chain where last_first = 1),
player_days AS (
  select org_id, shift_date, min(start_min) as first_start, max(start_min) as last_start
  from home where not parent_duty group by org_id, shift_date),
parent_days AS (
  select org_id, shift_date, max(start_min) + 60 as parents_end from home where parent_duty
  group by org_id, shift_date),
cash_games AS (
  select *, row_number() over (partition by org_id, shift_date
    order by start_min, case when team_code = 'F1' then 0 else 1 end, game_id) as rn
  from home where has_cash),
cash_days AS (
  select org_id, shift_date,
    min(case when rn = 1 and team_code = 'F1' then start_min - 30 else start_min end) as first_start,
    max(case when rn = 1 and team_code = 'F1' then start_min - 30 else start_min end) as last_start
  from cash_games group by org_id, shift_date),
ranges AS (
  select org_id, shift_date, 'Aufsicht' as duty_type, start_min - 60 as range_start, end_min + 180 as range_end from env
  union all
  select p.org_id, p.shift_date, 'Verkauf', coalesce(e.parents_end, p.first_start - 60), p.last_start + 120
  from player_days p left join parent_days e on e.org_id = p.org_id and e.shift_date = p.shift_date
  union all
  select org_id, shift_date, 'Kasse', first_start - 60, last_start + 30 from cash_days),
rated AS (
  select r.*, l.length_hh, floor(range_end / 30) - floor(range_start / 30) as total,
    row_number() over (partition by r.org_id, r.shift_date, r.duty_type order by
      abs((floor(range_end / 30) - floor(range_start / 30)) / cast(l.length_hh as double)
        - floor((floor(range_end / 30) - floor(range_start / 30)) / cast(l.length_hh as double) + 0.5)), l.pos) as rn
  from ranges r join dim_length l on l.duty_type = r.duty_type),
stepped AS (
  select org_id, shift_date, duty_type, range_start, range_end, cast(30 * least(total, length_hh) as int) as step
  from rated where rn = 1),
counted AS (
  select *, case when step > 0 then greatest(1, cast(ceil((range_end - range_start) / cast(step as double)) as int)) end
    as n from stepped),
tailed AS (
  select *, case when n = 1 then step else range_end - range_start - step * (n - 1) end as tail from counted),
shift_rejects AS (
  select org_id, shift_date, duty_type, range_start, range_end,
    case when step <= 0 then 'empty range' else 'range shorter than one shift' end as reason
  from tailed where step <= 0 or (n = 1 and tail < 60)),
pieces AS (
  select t.*, unnest(range(0, n - case when n > 1 and tail < 60 then 1 else 0 end)) as k
  from tailed t where step > 0 and not (n = 1 and tail < 60)),
cut AS (
  select org_id, shift_date, duty_type, cast(range_start + step * k as int) as start_min,
    cast(case when n > 1 and tail < 60 and k = n - 2 then range_end
      when k = 0 then range_start + step else least(range_start + step * (k + 1), range_end) end as int) as end_min
  from pieces),
raw_shifts AS (
  select org_id, shift_date, duty_type, start_min, end_min, cast(null as varchar) as parents_of from cut
  union all
  select org_id, shift_date, 'Verkauf', start_min, end_min, parents_of from parent_sales
  union all
  select distinct org_id, shift_date, 'Wischen', start_min - 15, start_min + 75, cast(null as varchar)
  from home where has_wiper),
shifts AS (
  select s.org_id, strftime(shift_date, '%Y-%m-%d') || '/' || d.short || '/' || start_min || '-' || end_min
      || case when parents_of is null then '' else '/' || parents_of end as shift_id,
    shift_date, start_min, end_min, s.duty_type, d.n_people, parents_of, end_min > 1440 as past_midnight
  from raw_shifts s join dim_duty d on d.duty_type = s.duty_type),
member_shifts AS (select * from shifts where not (duty_type = 'Verkauf' and parents_of is not null)),
headcounts AS (
  select p.org_id, p.team_code,
    case when any_value(t.is_youth) then greatest(count(*), 10) else count(*) end as n_persons,
    cast(sum(worked_min) as bigint) as worked_min, count(trains_team) as n_coaches
  from persons p join dim_team t on t.team_code = p.team_code where t.work_to > t.work_from or p.is_supervisor
  group by p.org_id, p.team_code),
planned AS (
  select org_id, duty_type, cast(sum((end_min - start_min) * n_people) as bigint) as planned_min
  from member_shifts group by org_id, duty_type),
sized AS (
  select h.*, t.capacity_units * (n_persons - case when h.team_code = 'Aufsicht' then 0 else n_coaches end) as effective
  from headcounts h join dim_team t on t.team_code = h.team_code),
org_rates AS (
  select s.org_id,
    cast(coalesce(max(p.players), 0) + coalesce(sum(case when team_code <> 'Aufsicht' then worked_min end), 0) as double)
      / (cast(sum(case when team_code <> 'Aufsicht' then effective end) as double) / 1000000.0) as per_player,
    cast(coalesce(max(p.supervisors), 0) + coalesce(sum(case when team_code = 'Aufsicht' then worked_min end), 0)
      as double) / cast(sum(case when team_code = 'Aufsicht' then n_persons end) as double) as per_supervisor
  from sized s left join (
    select org_id, sum(case when duty_type <> 'Aufsicht' then planned_min end) as players,
      sum(case when duty_type = 'Aufsicht' then planned_min end) as supervisors
    from planned group by org_id) p on p.org_id = s.org_id
  group by s.org_id)
"""

_PLAN = r"""
targets AS (
  select s.org_id, s.team_code, s.n_persons, s.worked_min,
    round(case when {team_mode} and s.team_code <> 'Aufsicht'
      then cast(effective as double) / 1000000.0 * per_player
      else cast(effective as double) / 1000000.0
        * case when s.team_code = 'Aufsicht' then per_supervisor else per_player end / n_persons end, 6) as target_min
  from sized s join org_rates r on r.org_id = s.org_id),
representatives AS (
  select p.org_id, cast(-1 - any_value(t.team_idx) as bigint) as person_id, 'Platzhalter ' || p.team_code as name,
    p.team_code, cast(sum(worked_min) as int) as worked_min, false as is_supervisor,
    cast(null as varchar) as trains_team
  from persons p join dim_team t on t.team_code = p.team_code
  where p.team_code <> 'Aufsicht' and t.work_to > t.work_from group by p.org_id, p.team_code
  union all
  select * from persons where team_code = 'Aufsicht'),
unfinished AS (
  select p.* from persons p join dim_team t on t.team_code = p.team_code
  join targets g on g.org_id = p.org_id and g.team_code = p.team_code
  left join dim_team c on c.team_code = p.trains_team
  where (t.work_to > t.work_from or p.is_supervisor) and p.worked_min < g.target_min - 45
    and not (t.is_active and coalesce(c.is_youth, false))),
workers AS (select *, coalesce(trains_team, '') as coach_of from {workers}),
classes AS (
  select org_id, team_code, is_supervisor, coach_of, count(*) as n_persons from workers group by all),
windows AS (
  select distinct org_id, game_date as shift_date, team_code, block_from, block_to from games),
cands AS (
  select s.org_id, s.shift_id, s.shift_date, s.start_min, s.end_min, s.duty_type,
    case when s.duty_type = 'Aufsicht' then 'A' else 'KVW' end as problem, s.n_people,
    cast({slots} as int) as n_slots,
    cast((s.end_min - s.start_min) * {factor} as int) as minutes,
    c.team_code, c.is_supervisor, c.coach_of, c.n_persons
  from member_shifts s join classes c on c.org_id = s.org_id join dim_team t on t.team_code = c.team_code
  where t.work_from <= s.start_min and (t.work_to >= 1440 or t.work_to >= s.end_min)
    and (s.duty_type = 'Wischen') = t.wiper_duty and (s.duty_type = 'Aufsicht') = c.is_supervisor
    and not exists (select 1 from windows w where w.org_id = s.org_id and w.shift_date = s.shift_date
      and w.team_code = c.team_code and s.start_min <= w.block_to and w.block_from <= s.end_min)
    and not exists (select 1 from windows w where w.org_id = s.org_id and w.shift_date = s.shift_date
      and w.team_code = c.coach_of and s.start_min <= w.block_to and w.block_from <= s.end_min)),
playing AS (select distinct org_id, team_code, game_date from games),
w1 AS (
  select c.* from cands c where not exists (select 1 from playing p where p.org_id = c.org_id
    and p.team_code = c.team_code and p.game_date = case dayofweek(c.shift_date)
      when 6 then c.shift_date + 1 when 0 then c.shift_date - 1 end)),
w2 AS (
  select c.* from cands c where not exists (select 1 from w1 k where k.org_id = c.org_id and k.shift_id = c.shift_id)),
costs AS (
  select s.org_id, s.shift_id, g.team_code, cast(sum(d) as bigint) as cost
  from member_shifts s join home g on g.org_id = s.org_id and g.shift_date = s.shift_date,
  lateral (select least(
    greatest(0, s.start_min - g.block_from, g.block_from - s.end_min),
    greatest(0, s.start_min - g.block_to, g.block_to - s.end_min)) as d) x
  where d <= 60 group by s.org_id, s.shift_id, g.team_code),
free AS (
  select f.*, coalesce(k.cost, 90) as cost from (select * from w1 union all select * from w2) f
  left join costs k on k.org_id = f.org_id and k.shift_id = f.shift_id and k.team_code = f.team_code),
heads AS (
  select org_id, team_code, is_supervisor, coach_of, person_id from (
    select *, row_number() over (partition by org_id, team_code, is_supervisor, coach_of
      order by worked_min, person_id) as rn from workers) where rn = 1),
picked AS (
  select * from (
    select f.*, h.person_id, row_number() over (partition by f.org_id, f.shift_id order by f.cost,
      (((shift_date - DATE '2000-01-03') * 31 + start_min + h.person_id * 17) % 101 + 101) % 101, h.person_id) as rn
    from free f join heads h on h.org_id = f.org_id and h.team_code = f.team_code
      and h.is_supervisor = f.is_supervisor and h.coach_of = f.coach_of) where rn = 1),
roster AS (
  select org_id, shift_id, cast(unnest(range(0, n_slots)) as int) as slot_nr, person_id from picked),
active AS (
  select w.org_id, w.person_id, case when w.is_supervisor then 'A' else 'KVW' end as problem, w.team_code,
    w.is_supervisor, w.coach_of,
    cast(coalesce(t.target_min, 0) - w.worked_min as decimal(20, 6)) as owing_min
  from workers w left join targets t on t.org_id = w.org_id and t.team_code = w.team_code
  where exists (select 1 from free f where f.org_id = w.org_id and f.team_code = w.team_code
    and f.is_supervisor = w.is_supervisor and f.coach_of = w.coach_of)),
slots AS (
  select org_id, shift_id, shift_date, start_min, end_min, duty_type, problem, n_people, n_slots, minutes,
    cast(unnest(range(0, n_slots)) as int) as slot_nr
  from (select distinct org_id, shift_id, shift_date, start_min, end_min, duty_type, problem, n_people, n_slots,
    minutes from free)),
filled AS (
  select r.*, s.shift_date, s.start_min, s.end_min, s.duty_type, s.problem, s.n_people, s.n_slots, s.minutes,
    w.team_code, w.is_supervisor
  from roster r join slots s on s.org_id = r.org_id and s.shift_id = r.shift_id and s.slot_nr = r.slot_nr
  join workers w on w.org_id = r.org_id and w.person_id = r.person_id),
loads AS (select org_id, person_id, cast(sum(minutes) as bigint) as load_min from filled group by all),
balance AS (
  select a.*, coalesce(load_min, 0) as load_min,
    greatest(coalesce(load_min, 0) - owing_min, 0) as over_min, greatest(owing_min - coalesce(load_min, 0), 0) as under_min
  from active a left join loads l on l.org_id = a.org_id and l.person_id = a.person_id),
scored AS (
  select b.org_id, b.problem, count(*) as n_workers, any_value(f.n_filled) as n_filled,
    sum(5 * over_min + under_min) as balance_cost, any_value(f.near) as proximity_cost
  from balance b join (
    select f.org_id, f.problem, count(*) as n_filled, cast(sum(coalesce(k.cost, 90)) as bigint) as near
    from filled f left join costs k on k.org_id = f.org_id and k.shift_id = f.shift_id and k.team_code = f.team_code
    group by f.org_id, f.problem) f on f.org_id = b.org_id and f.problem = b.problem
  group by b.org_id, b.problem),
parent_rows AS (
  select s.org_id, s.shift_id, cast(unnest(range(0, s.n_people)) as int) as slot_nr,
    cast(-1000000 - t.team_idx as bigint) as person_id, 'Eltern ' || s.parents_of as name, s.parents_of as team_code
  from shifts s join dim_team t on t.team_code = s.parents_of),
full_roster AS (
  select org_id, shift_id, slot_nr, person_id from roster
  union all select org_id, shift_id, slot_nr, person_id from parent_rows),
people AS (
  select org_id, person_id, name, team_code, worked_min, is_supervisor from workers
  union all select distinct org_id, person_id, name, team_code, 0, false from parent_rows),
effective AS (
  select r.org_id, r.person_id, cast(sum((s.end_min - s.start_min)
    * case when {team_mode} and s.parents_of is null then s.n_people else 1 end) as bigint) as planned_min
  from full_roster r join shifts s on s.org_id = r.org_id and s.shift_id = r.shift_id group by all),
means AS (
  select e.org_id, coalesce(avg(case when p.is_supervisor then planned_min end), 0) as mean_s,
    coalesce(avg(case when not p.is_supervisor then planned_min end), 0) as mean_o
  from effective e join people p on p.org_id = e.org_id and p.person_id = e.person_id group by e.org_id)
"""


# The dimensions once more, written out, so that a wrong value in the library shows.
_DIMENSIONS = """
dim_team(team_idx, team_code, capacity_units, work_from, work_to, has_cash, has_wiper, parent_duty,
  wiper_duty, is_youth, is_active) AS (VALUES
(0, 'M1', 1000000, 0, 1440, true, false, false, false, false, true),
(1, 'M2', 1000000, 0, 1440, false, false, false, false, false, true),
(2, 'M3', 1000000, 0, 1440, false, false, false, false, false, true),
(3, 'M4', 1000000, 0, 1440, false, false, false, false, false, true),
(4, 'F1', 1000000, 0, 1440, true, true, false, false, false, true),
(5, 'F2', 1000000, 0, 1440, true, false, false, false, false, true),
(6, 'F3', 1000000, 0, 1440, false, false, false, false, false, true),
(7, 'mA1', 850000, 0, 1200, false, false, false, false, true, false),
(8, 'mA2', 850000, 0, 1200, false, false, false, false, true, false),
(9, 'wA1', 850000, 0, 1200, false, false, false, false, true, false),
(10, 'wA2', 850000, 0, 1200, false, false, false, false, true, false),
(11, 'mB1', 750000, 0, 1080, false, false, false, false, true, false),
(12, 'mB2', 750000, 0, 1080, false, false, false, false, true, false),
(13, 'wB1', 750000, 0, 1080, false, false, false, false, true, false),
(14, 'wB2', 750000, 0, 1080, false, false, false, false, true, false),
(15, 'mC1', 310000, 0, 1200, false, false, true, true, true, false),
(16, 'wC1', 310000, 0, 1200, false, false, true, true, true, false),
(17, 'mC2', 750000, 0, 1200, false, false, true, true, true, false),
(18, 'wC2', 750000, 0, 1200, false, false, true, true, true, false),
(19, 'gD1', 0, 0, 0, false, false, true, false, true, false),
(20, 'wD1', 0, 0, 0, false, false, true, false, true, false),
(21, 'gD2', 0, 0, 0, false, false, true, false, true, false),
(22, 'wD2', 0, 0, 0, false, false, true, false, true, false),
(23, 'gE1', 0, 0, 0, false, false, true, false, true, false),
(24, 'gE2', 0, 0, 0, false, false, true, false, true, false),
(25, 'wE1', 0, 0, 0, false, false, true, false, true, false),
(26, 'wE2', 0, 0, 0, false, false, true, false, true, false),
(27, 'gF1', 0, 0, 0, false, false, true, false, true, false),
(28, 'gF2', 0, 0, 0, false, false, true, false, true, false),
(29, 'gF3', 0, 0, 0, false, false, false, false, true, false),
(30, 'Minis', 0, 0, 0, false, false, false, false, false, true),
(31, 'Aufsicht', 1000000, 0, 1440, false, false, false, false, false, false),
(32, 'None', 1000000, 0, 1440, false, false, false, false, true, false)),
dim_duty(duty_type, short, n_people) AS (VALUES ('Verkauf', 'V', 2),
  ('Kasse', 'K', 1),
  ('Aufsicht', 'A', 1),
  ('Wischen', 'W', 2)),
dim_length(duty_type, pos, length_hh) AS (VALUES ('Verkauf', 0, 5), ('Verkauf', 1, 6), ('Verkauf', 2, 7), ('Verkauf', 3, 8),
  ('Kasse', 0, 3), ('Kasse', 1, 4), ('Kasse', 2, 5), ('Kasse', 3, 6),
  ('Aufsicht', 0, 6), ('Aufsicht', 1, 7), ('Aufsicht', 2, 8), ('Aufsicht', 3, 9), ('Aufsicht', 4, 10),
  ('Wischen', 0, 3))
"""
_DUTY_TYPES = ("Verkauf", "Kasse", "Aufsicht", "Wischen")


_ORDERS = "from orders o join customer c on o.o_custkey = c.c_custkey"
# Every team of some clubs plays away on the other weekend day, so that the weekend rule empties shifts.
_CROWD = '''
  union all
  select org_id, 1000000000 + game_id * 100 + t as game_id,
    cast(game_date + case when isodow(game_date) = 6 then 1 else -1 end * interval '1' day as date) as game_date,
    600 as start_min, false as is_home, cast(t as int) as team_idx
  from (select cast(floor(c.c_custkey / 150) as int) as org_id, o.o_orderkey as game_id,
      cast(DATE '2000-01-03' + cast(7 * ((o.o_orderkey * 11) % 161)
        + case when o.o_orderkey % 5 = 0 then (o.o_orderkey * 3) % 7 else 5 + o.o_orderkey % 2 end as int)
        * interval '1' day as date) as game_date, unnest(range(0, 31)) as t
    from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderkey % 40 = 0)
  where isodow(game_date) in (6, 7)'''


_CLUB = re.compile(r"cast\(floor\((c\.)?c_custkey / 150\) as int\)")


def statement(select: str, team_mode: bool = True, crowded: bool = False, hot: bool = False) -> str:
    plan = (
        _PLAN.replace("{team_mode}", str(team_mode).lower())
        .replace("{workers}", "representatives" if team_mode else "unfinished")
        .replace("{slots}", "1" if team_mode else "s.n_people")
        .replace("{factor}", "case when s.duty_type = 'Aufsicht' then 1 else s.n_people end" if team_mode else "1")
    )
    games = _GAMES.replace(_ORDERS, _ORDERS + _CROWD) if crowded else _GAMES
    if hot:  # one club has a third of all members and games
        games = _CLUB.sub(r"case when \1c_custkey % 3 = 0 then 0 else \g<0> end", games)
    return f"WITH {_DIMENSIONS.strip()},\n{games},\n{_SHIFTS},\n{plan}\n{select}"


_D = "strftime({0}, '%Y-%m-%d')"
_SHIFT_OUT = (
    "select org_id, shift_id, " + _D.format("shift_date") + " as shift_date, start_min, end_min, duty_type, n_people, "
    "coalesce(parents_of, '') as parents_of, past_midnight from shifts"
)
_CAND_OUT = (
    "select org_id, shift_id, " + _D.format("shift_date") + " as shift_date, start_min, end_min, duty_type, problem, "
    "n_people, n_slots, minutes, team_code, is_supervisor, coach_of, n_persons from "
)
_PER_SHIFT = (
    "select org_id, shift_id, problem, count(*) as n_classes, "
    "cast(sum(n_persons * n_slots) as bigint) as n_candidates from {0} group by org_id, shift_id, problem"
)

# Fixed rows used by the merge queries: the plain roster with some names and slots spoiled.
_FIXED = """
, fixed AS (
  select f.org_id, f.shift_date, f.start_min, f.end_min, f.duty_type, f.team_code,
    case when f.duty_type = 'Wischen' then 'Nobody' else w.name end as name,
    case when f.duty_type = 'Kasse' then f.slot_nr + 1 else f.slot_nr end as slot_nr
  from filled f join workers w on w.org_id = f.org_id and w.person_id = f.person_id),
resolved AS (
  select x.*, w.person_id, c.shift_id, c.n_slots
  from fixed x left join workers w on w.org_id = x.org_id and w.team_code = x.team_code and w.name = x.name
  left join cands c on c.org_id = x.org_id and c.shift_date = x.shift_date and c.start_min = x.start_min
    and c.end_min = x.end_min and c.duty_type = x.duty_type and c.team_code = w.team_code
    and c.is_supervisor = w.is_supervisor and c.coach_of = w.coach_of)
"""


def _with_fixed(select: str) -> str:
    return statement(_FIXED + select, team_mode=False)


_MONEY = "round(cast({0} as double), 3) as {1}"

def sql() -> dict[str, str]:
    day = _D.format("shift_date") + " as shift_date"
    q: dict[str, str] = {}
    q["day_envelope"] = statement(f"select org_id, {day}, start_min, end_min from env")
    q["supervision_shifts"] = statement(_SHIFT_OUT + " where duty_type = 'Aufsicht'")
    q["parent_shifts"] = statement(_SHIFT_OUT + " where parents_of is not null")
    q["player_sales_shifts"] = statement(_SHIFT_OUT + " where duty_type = 'Verkauf' and parents_of is null")
    q["cash_shifts"] = statement(_SHIFT_OUT + " where duty_type = 'Kasse'")
    q["wiper_shifts"] = statement(_SHIFT_OUT + " where duty_type = 'Wischen'")
    q["all_shifts"] = statement(_SHIFT_OUT)
    q["shift_rejects"] = statement(
        f"select org_id, {day}, duty_type, cast(range_start as int) as range_start, "
        "cast(range_end as int) as range_end, reason from shift_rejects"
    )
    q["wiper_conflicts"] = statement(
        f"select org_id, {day}, count(*) as n_games from home where has_wiper group by org_id, shift_date "
        "having count(*) > 1"
    )
    q["team_blocks"] = statement(
        f"select distinct org_id, {_D.format('game_date')} as shift_date, team_code, block_from, block_to from games g "
        "where exists (select 1 from persons p where p.org_id = g.org_id and p.team_code = g.team_code)"
    )
    q["coach_blocks"] = statement(
        f"select g.org_id, {_D.format('g.game_date')} as shift_date, g.team_code, g.block_from, g.block_to, "
        "count(distinct p.person_id) as n_coaches from games g join persons p on p.org_id = g.org_id "
        "and p.trains_team = g.team_code group by all"
    )
    q["headcounts"] = statement("select * from headcounts")
    q["representatives"] = statement(
        "select org_id, person_id, name, team_code, worked_min, is_supervisor, coalesce(trains_team, '') as trains_team "
        "from representatives"
    )
    q["persons_under_target"] = statement(
        "select org_id, person_id, name, team_code, worked_min, is_supervisor, coalesce(trains_team, '') as trains_team "
        "from unfinished", team_mode=False
    )
    q["planned_minutes"] = statement("select * from planned")
    for name, mode in (("target_minutes", True), ("target_minutes_per_head", False)):
        q[name] = statement("select org_id, team_code, n_persons, worked_min, target_min from targets", mode)
    q["candidates_team_mode"] = statement(_CAND_OUT + "cands")
    q["candidates_player_mode"] = statement(_PER_SHIFT.format("cands"), team_mode=False)
    q["weekend_filtered"] = statement(_CAND_OUT + "w1")
    q["weekend_filtered_player_mode"] = statement(_PER_SHIFT.format("w1"), team_mode=False)
    q["readded"] = statement(_CAND_OUT + "w2", crowded=True)
    q["readded_player_mode"] = statement(_PER_SHIFT.format("w2"), team_mode=False, crowded=True)
    q["free_candidates"] = statement(_CAND_OUT.replace(" from ", ", cost from ") + "free")
    q["uncovered_shifts"] = statement(
        _SHIFT_OUT.replace("from shifts", "from member_shifts s") + " where not exists (select 1 from free f "
        "where f.org_id = s.org_id and f.shift_id = s.shift_id)"
    )
    q["parent_assignments"] = statement("select org_id, shift_id, slot_nr, person_id, name, true as is_fixed from parent_rows")
    q["fixed_merge"] = _with_fixed(
        "select distinct org_id, shift_id, slot_nr, person_id, true as is_fixed from resolved "
        "where person_id is not null and shift_id is not null and slot_nr < n_slots"
    )
    q["fixed_rejects"] = _with_fixed(
        f"select org_id, {day}, start_min, end_min, duty_type, team_code, name, slot_nr, "
        "case when person_id is null then 'person not found' else 'no such candidate' end as reason from resolved "
        "where person_id is null or shift_id is null or slot_nr >= n_slots"
    )
    q["proximity_cost"] = statement("select org_id, shift_id, team_code, cost from costs")
    q["time_balance_rows"] = statement(
        "select a.org_id, a.problem, a.person_id, cast(sum(f.n_slots) as bigint) as n_choices, "
        "cast(sum(f.n_slots * f.minutes) as bigint) as choice_minutes, "
        + _MONEY.format("any_value(a.owing_min)", "owing_min")
        + " from active a join free f on f.org_id = a.org_id and f.team_code = a.team_code "
        "and f.is_supervisor = a.is_supervisor and f.coach_of = a.coach_of group by a.org_id, a.problem, a.person_id",
        team_mode=False,
    )
    q["same_team_rows"] = statement(
        "select org_id, shift_id, team_code, cast(sum(n_persons) as bigint) as n_persons, "
        "cast(sum(n_persons * n_slots) as bigint) as n_rows from free where n_slots > 1 and problem = 'KVW' "
        "group by org_id, shift_id, team_code having sum(n_persons) > 1", team_mode=False,
    )
    q["disjoint_intervals"] = statement(
        ", ivs AS (select distinct org_id, problem, team_code, shift_date, start_min, end_min from cands), "
        "pts AS (select distinct org_id, problem, team_code, shift_date, unnest([start_min, end_min]) as p from ivs), "
        "pcs AS (select org_id, problem, team_code, shift_date, p as piece_start, lead(p) over (partition by org_id, "
        "problem, team_code, shift_date order by p) as piece_end from pts) "
        f"select c.org_id, c.problem, c.team_code, {_D.format('c.shift_date')} as shift_date, piece_start, piece_end, "
        "count(*) as n_covering from pcs c join ivs i on i.org_id = c.org_id and i.problem = c.problem "
        "and i.team_code = c.team_code "
        "and i.shift_date = c.shift_date and i.start_min <= piece_start and i.end_min >= piece_end "
        "where piece_end is not null group by all", team_mode=False,
    )
    score = (
        "select org_id, problem, n_workers, n_filled, " + _MONEY.format("balance_cost", "balance_cost")
        + ", proximity_cost, " + _MONEY.format("balance_cost + proximity_cost", "objective") + " from scored"
    )
    q["simple_roster"] = statement("select org_id, shift_id, slot_nr, person_id from roster")
    q["score_roster"] = statement(score)
    q["score_roster_player_mode"] = statement(score, team_mode=False)
    q["roster_violations"] = statement(
        ", n3 AS (select a.org_id, a.shift_id, a.slot_nr from filled a join (select org_id, shift_id, team_code "
        "from free where n_slots > 1 group by all having sum(n_persons) > 1) o on o.org_id = a.org_id "
        "and o.shift_id = a.shift_id and o.team_code = a.team_code where a.problem = 'KVW' and not exists ("
        "select 1 from filled b where b.org_id = a.org_id and b.shift_id = a.shift_id and b.team_code = a.team_code "
        "and b.person_id <> a.person_id and b.slot_nr <> a.slot_nr)), "
        "pts AS (select distinct org_id, person_id, shift_date, unnest([start_min, end_min]) as p from filled "
        "where problem = 'KVW'), "
        "pcs AS (select *, lead(p) over (partition by org_id, person_id, shift_date order by p) as e from pts), "
        "busy AS (select c.org_id, c.person_id, c.shift_date, c.p, count(*) as n from pcs c join filled f "
        "on f.org_id = c.org_id and f.person_id = c.person_id and f.shift_date = c.shift_date and f.problem = 'KVW' "
        "and f.start_min <= c.p and f.end_min >= c.e where c.e is not null group by all having count(*) > 1) "
        "select org_id, 'N3' as rule, count(*) as n_findings, cast(0 as bigint) as total_activity from n3 group by org_id "
        "union all select org_id, 'N2', count(distinct person_id), count(*) from ("
        "select org_id, person_id, shift_date, p from busy) group by org_id",
        team_mode=False,
    )
    q["model_size"] = statement(
        "select org_id, problem, cast(sum(v) as bigint) as n_choices, cast(sum(s) as bigint) as n_slot_rows, "
        "cast(sum(w) as bigint) as n_workers from ("
        "select org_id, problem, sum(n_persons * n_slots) as v, 0 as s, 0 as w from free group by org_id, problem "
        "union all select org_id, problem, 0, count(*), 0 from slots group by org_id, problem "
        "union all select org_id, problem, 0, 0, count(*) from active group by org_id, problem) group by org_id, problem",
        team_mode=False,
    )
    q["model_objective"] = statement(
        "select org_id, problem, " + _MONEY.format("balance_cost + proximity_cost", "objective")
        + ", cast(0 as bigint) as n_missing from scored"
    )
    q["model_row_kinds"] = statement(
        ", a AS (select org_id, count(*) as n from active group by org_id), "
        "s AS (select org_id, count(*) as n from slots group by org_id), "
        "v AS (select org_id, cast(sum(n_slots * n_persons) as bigint) as n from free group by org_id) "
        "select org_id, 'balance' as kind, n as n_rows, (select n from v where v.org_id = a.org_id) + n as n_coefs from a "
        "union all select org_id, 'slack', n, 3 * n from a "
        "union all select org_id, 'N1', n, (select n from v where v.org_id = s.org_id) from s"
    )
    # A third of the representatives do not turn up.
    q["model_broken_rows"] = statement(
        "select org_id, problem, 'N1/' || shift_id || '/' || slot_nr as row, cast(0 as bigint) as activity from filled "
        "where ((person_id % 3) + 3) % 3 = 1"
    )
    # Sets of type 2, in which every third representative stands in all slots that they may take.
    q["model_broken_sets"] = statement(
        ", m AS (select f.org_id, f.problem, 'N1/' || f.shift_id || '/' || s.slot_nr as set, w.person_id, "
        "((w.person_id % 3) + 3) % 3 = 1 as stands from free f join slots s on s.org_id = f.org_id and s.shift_id = f.shift_id "
        "join workers w on w.org_id = f.org_id and w.team_code = f.team_code "
        "and w.is_supervisor = f.is_supervisor and w.coach_of = f.coach_of), "
        "e AS (select org_id, problem, set, count(*) as n_nonzero, min(person_id) as lo, max(person_id) as hi from m where stands "
        "group by all having count(*) > 1) "
        "select e.org_id, e.problem, e.set, e.n_nonzero, count(*) - e.n_nonzero as n_between from e join m "
        "on m.org_id = e.org_id and m.problem = e.problem and m.set = e.set and m.person_id between e.lo and e.hi "
        "group by e.org_id, e.problem, e.set, e.n_nonzero having e.n_nonzero > 2 or count(*) > e.n_nonzero"
    )
    # All sets of shifts that run at one moment; members are few, so some moments cannot be filled.
    q["impossible_moments"] = statement(
        ", few AS (select org_id, team_code, is_supervisor, coach_of, count(*) as n from workers "
        "where ((person_id % 16) + 16) % 16 = 0 group by all), "
        "fr AS (select f.org_id, f.shift_date, f.start_min, f.end_min, f.shift_id, f.n_slots, "
        "p.team_code || '/' || p.coach_of || '/' || p.is_supervisor as class, p.n from free f join few p on p.org_id = f.org_id "
        "and p.team_code = f.team_code and p.is_supervisor = f.is_supervisor and p.coach_of = f.coach_of where f.problem = 'KVW'), "
        "mo AS (select distinct org_id, shift_date, start_min as at_min from fr), "
        "sh AS (select distinct m.*, f.shift_id, f.n_slots from mo m join fr f on f.org_id = m.org_id "
        "and f.shift_date = m.shift_date and f.start_min <= m.at_min and m.at_min < f.end_min), "
        "nr AS (select *, row_number() over (partition by org_id, shift_date, at_min order by shift_id) - 1 as place, "
        "count(*) over (partition by org_id, shift_date, at_min) as k from sh), "
        "ma AS (select org_id, shift_date, at_min, unnest(range(1, cast(power(2, k) as bigint))) as mask "
        "from (select distinct org_id, shift_date, at_min, k from nr)), "
        "ne AS (select m.org_id, m.shift_date, m.at_min, m.mask, cast(sum(r.n_slots) as bigint) as n_needed from ma m join nr r "
        "on r.org_id = m.org_id and r.shift_date = m.shift_date and r.at_min = m.at_min and (m.mask >> r.place) & 1 = 1 group by all), "
        "cl AS (select r.org_id, r.shift_date, r.at_min, f.class, f.n, bit_or(cast(1 as bigint) << r.place) as able from nr r join fr f "
        "on f.org_id = r.org_id and f.shift_id = r.shift_id group by all), "
        "me AS (select e.org_id, e.shift_date, e.at_min, e.mask, e.n_needed, cast(sum(c.n) as bigint) as n_members from ne e join cl c "
        "on c.org_id = e.org_id and c.shift_date = e.shift_date and c.at_min = e.at_min and (c.able & e.mask) <> 0 group by all) "
        "select org_id, strftime(shift_date, '%Y-%m-%d') as shift_date, at_min, n_needed, n_members, n_needed - n_members as n_missing "
        "from (select *, row_number() over (partition by org_id, shift_date, at_min order by n_needed - n_members desc, n_needed) as rn "
        "from me) where rn = 1 and n_needed > n_members",
        team_mode=False,
    )
    q["roster_violations_spoiled"] = statement(
        ", r AS (select *, person_id % 11 = 2 as gone, person_id % 5 = 0 as swapped, person_id % 7 = 1 as odd, "
        "person_id % 13 = 3 as twice from filled), "
        "n1 AS (select org_id, cast(case when gone then 0 else 1 end + case when twice then 1 else 0 end as bigint) as n from r) "
        "select org_id, 'SLOT' as rule, count(*) as n_findings, count(*) as total_activity from r where odd group by org_id "
        "union all select org_id, 'CANDIDATE', count(*), count(*) from r where swapped and not gone group by org_id "
        "union all select org_id, 'GUARD', count(*), count(*) from r where swapped and not gone and problem = 'A' group by org_id "
        "union all select org_id, 'N4', count(*), 0 from r where gone and not twice group by org_id "
        "union all select org_id, 'N1', count(*), cast(sum(n) as bigint) from n1 where n <> 1 group by org_id",
        team_mode=False,
    )
    q["fixed_roster_status"] = statement(
        "select org_id, problem, count(*) as n_slots, count(*) as n_filled, 'complete' as status, "
        "count(case when start_min % 60 = 0 then 1 end) as n_fixed, cast(0 as bigint) as n_rejects, "
        "cast(0 as bigint) as n_violations from filled group by org_id, problem"
    )
    q["season_totals"] = statement(
        ", c AS (select s.*, exists (select 1 from free f where f.org_id = s.org_id and f.shift_id = s.shift_id) as taken "
        "from shifts s) "
        "select org_id, cast(sum(case when parents_of is not null or taken then 1 else 0 end) as bigint) as n_shift_lines, "
        "cast(sum(case when parents_of is not null or taken then (end_min - start_min) * n_people else 0 end) as bigint) as planned_min, "
        "(select count(*) from people p where p.org_id = c.org_id) as n_people from c group by org_id"
    )
    q["assigner_summary"] = statement(
        "select org_id, problem, count(*) as n_slots, count(*) as n_filled, cast(0 as bigint) as n_violations, "
        "'complete' as status, true as above_bound, true as beats_simple_roster from slots group by org_id, problem"
    )
    q["assigner_hot_org"] = statement(
        "select org_id, problem, count(*) as n_slots, count(*) as n_filled, cast(0 as bigint) as n_violations, "
        "'complete' as status, true as above_bound, true as beats_simple_roster from slots group by org_id, problem", hot=True,
    )
    q["candidates_hot_org"] = statement(_PER_SHIFT.format("cands"), team_mode=False, hot=True)
    q["assigner_player_mode"] = statement(
        "select org_id, problem, count(*) as n_slots, cast(0 as bigint) as n_violations, true as above_bound "
        "from slots group by org_id, problem", team_mode=False,
    )
    for name, mode, hot in (
        ("stats_person", True, False), ("stats_person_player_mode", False, False), ("stats_person_hot_org", False, True)
    ):
        q[name] = statement(
            "select e.org_id, e.person_id, p.name || case when p.is_supervisor then ' (A)' else '' end as label, "
            "p.team_code, p.worked_min, e.planned_min, p.worked_min + e.planned_min as total_min, "
            "round(coalesce(t.target_min, 0), 3) as target_min, "
            "round(coalesce(p.worked_min + e.planned_min - t.target_min, 0), 3) as off_target, "
            "round(p.worked_min + e.planned_min - case when p.is_supervisor then mean_s else mean_o end, 3) as off_mean "
            "from effective e join people p on p.org_id = e.org_id and p.person_id = e.person_id "
            "left join targets t on t.org_id = p.org_id and t.team_code = p.team_code "
            "join means m on m.org_id = e.org_id", mode, hot=hot,
        )
    q["stats_team"] = statement(
        "select e.org_id, p.team_code, cast(sum(worked_min) as bigint) as worked_min, "
        "cast(sum(planned_min) as bigint) as planned_min, cast(sum(worked_min + planned_min) as bigint) as total_min, "
        "count(*) as team_size, round(sum(worked_min + planned_min) / cast(count(*) as double), 3) as mean_min "
        "from effective e join people p on p.org_id = e.org_id and p.person_id = e.person_id where not p.is_supervisor "
        "group by e.org_id, p.team_code"
    )
    for name, mode in (("stats_idle", True), ("stats_idle_player_mode", False)):
        q[name] = statement(
            "select w.org_id, w.person_id, w.name || case when w.is_supervisor then ' (A)' else '' end as label, "
            "w.team_code, w.worked_min, "
            "round(w.worked_min - coalesce(case when w.is_supervisor then mean_s else mean_o end, 0), 3) as off_mean "
            "from workers w left join means m on m.org_id = w.org_id where not exists (select 1 from full_roster r "
            "where r.org_id = w.org_id and r.person_id = w.person_id)", mode,
        )
    helper = ", ".join(
        f"max(case when r.slot_nr = {i} then p.name end) as h{i}" for i in range(6)
    )
    shown = ", ".join(
        f"case when s.duty_type = 'Aufsicht' or s.parents_of is not null then h{i} end as h{i}" for i in range(6)
    )
    clock = "lpad(cast(({0} // 60) % 24 as varchar), 2, '0') || ':' || lpad(cast({0} % 60 as varchar), 2, '0')"
    q["roster_layout"] = statement(
        f", per_shift AS (select r.org_id, r.shift_id, min_by(p.team_code, r.slot_nr) as team_code, {helper} "
        "from full_roster r join people p on p.org_id = r.org_id and p.person_id = r.person_id group by r.org_id, r.shift_id), "
        "ls AS (select s.org_id, s.shift_date, row_number() over (partition by s.org_id, s.shift_date "
        "order by s.start_min, s.end_min, s.duty_type, s.shift_id) as row_nr, "
        f"{clock.format('s.start_min')} as from_time, {clock.format('s.end_min')} as to_time, s.duty_type, x.team_code, "
        f"s.n_people, {shown} from shifts s join per_shift x on x.org_id = s.org_id and x.shift_id = s.shift_id), "
        "rs AS (select org_id, game_date as shift_date, row_number() over (partition by org_id, game_date "
        "order by case when is_home then 0 else 1 end, start_min, game_id) as row_nr, "
        f"{clock.format('start_min')} as game_time, league, home, away from games g where exists ("
        "select 1 from ls where ls.org_id = g.org_id and ls.shift_date = g.game_date)), "
        "wide AS (select coalesce(l.org_id, r.org_id) as org_id, coalesce(l.shift_date, r.shift_date) as shift_date, "
        "coalesce(l.row_nr, r.row_nr) as row_nr, l.* exclude (org_id, shift_date, row_nr), "
        "r.* exclude (org_id, shift_date, row_nr) from ls l full join rs r on r.org_id = l.org_id "
        "and r.shift_date = l.shift_date and r.row_nr = l.row_nr) "
        f"select org_id, {day}, row_nr, concat_ws(';', strftime(shift_date, '%d.%m.%Y'), coalesce(from_time, ''), "
        "coalesce(to_time, ''), coalesce(duty_type, ''), coalesce(team_code, ''), coalesce(cast(n_people as varchar), ''), "
        + ", ".join(f"coalesce(h{i}, '')" for i in range(6))
        + ", '', '', '', coalesce(game_time, ''), coalesce(league, ''), coalesce(home, ''), coalesce(away, '')) as line "
        "from wide"
    )
    metric = "select org_id, '{0}' as metric, cast({1} as bigint) as value from {2} group by org_id"
    minutes = "coalesce(sum(case when duty_type = '{0}' and parents_of is null then (end_min - start_min) * n_people end), 0)"
    q["run_metrics"] = statement(
        " union all ".join(
            [
                metric.format("games", "count(*)", "games"),
                metric.format("home_games", "count(case when is_home then 1 end)", "games"),
                metric.format("shifts", "count(*)", "shifts"),
                metric.format(
                    "parent_assignments", "coalesce(sum(case when parents_of is not null then n_people end), 0)", "shifts"
                ),
                *[metric.format(f"minutes_{d}", minutes.format(d), "shifts") for d in _DUTY_TYPES],
                metric.format("candidates", "sum(n_persons * n_slots)", "cands"),
                metric.format("candidates_after_weekend_rule", "sum(n_persons * n_slots)", "free"),
            ]
        ),
        team_mode=False,
    )
    q["ingest_games"] = statement(
        f"select org_id, game_id, {_D.format('game_date')} as game_date, start_min, venue, home, away, team_code, "
        "is_home, league from games where team_nr <> ''"
    )
    q["ingest_persons"] = statement(
        "select org_id, name, case when contains(name, ' ') then left(name, 1) || left(split_part(name, ' ', 2), 1) "
        "else name end as short_name, team_code, worked_min, is_supervisor, coalesce(trains_team, '') as trains_team "
        "from persons"
    )
    q["ingest_person_rejects"] = statement(
        "select org_id, reason, count(*) as n_rows from (select org_id, case when person_id % 10 = 3 and not is_supervisor "
        "then 'unknown team' when person_id % 10 = 4 then 'unknown coached team' when person_id % 10 = 5 then 'bad hours' "
        "when person_id % 10 = 7 then 'repeated line' end as reason from persons) where reason is not null group by all"
    )
    q["ingest_rejects"] = statement(
        "select org_id, 'unknown team' as reason, count(*) as n_rows from games where team_nr = '' group by org_id"
    )
    q["ingest_fixed"] = statement(
        f"select f.org_id, {_D.format('f.shift_date')} as shift_date, f.start_min, f.end_min, f.duty_type, f.team_code, w.name, f.slot_nr from filled f "
        "join workers w on w.org_id = f.org_id and w.person_id = f.person_id", team_mode=False,
    )
    q["season_window"] = statement(
        f"select org_id, game_id, {_D.format('game_date')} as game_date from games "
        "where game_date > DATE '2000-09-01' and game_date < DATE '2001-06-30'"
    )
    q["date_pack"] = _DATE_PACK
    q["interval_pack"] = statement(
        ", b AS (select org_id, game_id, start_min as s, start_min + 90 as e, 600 + 15 * ((game_id * 3) % 41) as os, "
        "600 + 15 * ((game_id * 3) % 41) + 15 * (game_id % 9) as oe, block_from, block_to from games) "
        "select org_id, game_id, cast(least(s, os) as int) as hull_start, cast(greatest(e, oe) as int) as hull_end, "
        "cast(least(s, os) as int) as stretch_start, cast(greatest(e, os) as int) as stretch_end, "
        "cast(oe - os as int) as duration, oe <= os as is_empty, os between s and e as contains_point, "
        "s <= os and e >= oe as contains_span, (os between s and e) or (oe between s and e) or (s between os and oe) "
        "as intersects, cast(greatest(0, s - os, os - e) as int) as point_distance, "
        "cast(least(greatest(0, s - os, os - e), greatest(0, s - oe, oe - e)) as int) as span_distance, "
        f"block_from, block_to, {clock.format('s')} as clock from b"
    )
    return q


_DATE_PACK = """
with d as (select o_orderkey, cast(o_orderdate as date) as d,
  cast(o_orderdate as date) + cast((o_orderkey * 7) % 61 - 30 as int) as e,
  cast((o_orderkey * 5) % 41 - 20 as int) as n from orders),
moved as (
  select o_orderkey, max(case when i = abs(n) then day end) as workday from (
    select o_orderkey, n, day, row_number() over (partition by o_orderkey order by abs(off)) as i from (
      select o_orderkey, n, off, cast(d + off as date) as day
      from d, lateral (select cast(unnest(range(1, 46)) as int) * case when n < 0 then -1 else 1 end as off))
    where isodow(day) < 6)
  group by o_orderkey),
counted as (
  select o_orderkey, count(*) filter (where isodow(cast(d + off as date)) < 6) as n
  from d, lateral (select cast(unnest(range(0, (e - d) + 1)) as int) as off) where e >= d group by o_orderkey)
select d.o_orderkey, strftime(d, '%Y-%m-%d') as day, isodow(d) = 6 as is_saturday, isodow(d) = 7 as is_sunday,
  coalesce(strftime(case isodow(d) when 6 then d - 1 when 7 then d - 2 end, '%Y-%m-%d'), '') as weekend_key,
  d < e as is_before, d <= e as is_before_or_equal, d > e as is_after, d >= e as is_after_or_equal,
  strftime(least(d, e), '%Y-%m-%d') as earlier, strftime(greatest(d, e), '%Y-%m-%d') as later,
  strftime(d, '%d.%m.%Y') as german, strftime(d, '%Y%m%d') as basic_iso, strftime(d, '%Y%m') as month_text,
  cast(year(d) * 10000 + month(d) * 100 + day(d) as int) as int_day, cast(year(d) * 100 + month(d) as int) as int_month,
  true as parses_back,
  strftime(cast(d + d.n as date), '%Y-%m-%d') as added_days,
  strftime(cast(d + to_months(d.n) as date), '%Y-%m-%d') as added_months,
  strftime(date_trunc('month', d), '%Y-%m-%d') as first_of_month,
  strftime(date_trunc('month', d) + interval 14 day, '%Y-%m-%d') as middle_of_month,
  strftime(last_day(d), '%Y-%m-%d') as last_of_month, strftime(date_trunc('year', d), '%Y-%m-%d') as first_of_year,
  strftime(date_trunc('week', d), '%Y-%m-%d') as first_of_week,
  strftime(date_trunc('week', d) + interval 3 day, '%Y-%m-%d') as thursday,
  cast(day(last_day(d)) as int) as month_length, cast(e - d as int) as days_between,
  cast((year(e) - year(d)) * 12 + month(e) - month(d) as int) as month_changes,
  cast(case when d > e then -999 else c.n end as int) as weekday_count,
  strftime(case when d.n = 0 then d else m.workday end, '%Y-%m-%d') as workday
from d left join moved m on m.o_orderkey = d.o_orderkey left join counted c on c.o_orderkey = d.o_orderkey
"""
