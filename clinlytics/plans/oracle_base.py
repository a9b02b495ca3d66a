"""The clinic-table mapping of FIXTURES.md §2 as DuckDB CTEs.

Oracle queries for ``__spark_entry__.oracle_sql`` start with these CTEs so
they read the same nine clinic tables the Spark side derives. The text is
the fixture definition, kept verbatim so both engines agree.
"""
from __future__ import annotations

# The FIXTURES.md §2 mapping, in its documented order.
MAPPING_CTES = """
departments AS (
  select r_regionkey as id, r_name as name, cast(300 + 100*r_regionkey as decimal(10,2)) as consultation_fee,
         true as is_active from region),
users AS (
  select s_suppkey as id, concat('dr.', cast(s_suppkey as string)) as email, concat('Dr. ', s_name) as full_name,
         'doctor' as role, true as is_active from supplier),
doctors AS (
  select s.s_suppkey as id, s.s_suppkey as user_id, n.n_regionkey as department_id, s.s_suppkey % 10 <> 9 as is_active
  from supplier s join nation n on n.n_nationkey = s.s_nationkey),
patients AS (
  select c_custkey as id, c_mktsegment as first_name, c_name as last_name,
         date '1940-01-01' + cast((c_custkey * 37) % 25000 as int) as date_of_birth,
         case when c_custkey % 2 = 0 then 'male' else 'female' end as gender,
         concat('9', lpad(cast(c_custkey % 1400 as string), 9, '0')) as phone,
         case c_custkey % 5 when 0 then 'A+' when 1 then 'B+' when 2 then 'O-' when 3 then 'AB+' end as blood_group,
         c_custkey % 20 <> 0 as is_active,
         date '2000-01-01' + cast(c_custkey % 577 as int) as created_at from customer),
appointments AS (
  select o.o_orderkey as id, o.o_custkey as patient_id, d.id as doctor_id, d.department_id,
         cast(o.o_orderdate as date) as appointment_date,
         concat(lpad(cast(9 + cast(floor((floor(o.o_orderkey / n.c) % 16) / 2) as int) as string),2,'0'),
                case when cast(floor(o.o_orderkey / n.c) as bigint) % 2 = 0 then ':00' else ':30' end) as appointment_time,
         case o.o_orderpriority when '1-URGENT' then 'completed' when '2-HIGH' then 'completed'
              when '3-MEDIUM' then 'scheduled' when '4-NOT SPECIFIED' then 'cancelled' else 'no_show' end as status
  from orders o cross join (select count(*) as c from supplier) n join doctors d on d.id = o.o_orderkey % n.c),
visits AS (
  select a.id, a.id as appointment_id, a.patient_id, a.doctor_id,
         case when a.id % 3 <> 0 then concat('symptom ', cast(a.id % 10 as string)) end as symptoms,
         concat('diagnosis ', cast(a.id % 15 as string)) as diagnosis,
         case when a.id % 4 <> 0 then concat('I', cast(10 + a.id % 15 as string), '.', cast(a.id % 10 as string)) end as diagnosis_code,
         case when a.id % 5 <> 0 then concat('Tab. ', cast(a.id % 8 as string)) end as prescription,
         case when a.id % 2 = 0 then a.appointment_date + 14 end as follow_up_date,
         case when a.id % 4 = 0 then 'review' end as follow_up_notes,
         a.appointment_date as created_date from appointments a where a.status = 'completed'),
billing_items AS (
  select v.id as billing_record_id, 0 as item_no, concat(d.name, ' Consultation') as description,
         'consultation' as category, d.consultation_fee as amount
  from visits v join appointments a on a.id = v.appointment_id join departments d on d.id = a.department_id
  union all
  select l.l_orderkey, cast(row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey,
           l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate) as int),
         concat('Part ', cast(l.l_partkey as string)),
         case l.l_returnflag when 'A' then 'test' when 'R' then 'procedure' else 'other' end,
         cast(l.l_quantity * 10 as decimal(10,2))
  from lineitem l join visits v on v.id = l.l_orderkey),
billing_records AS (
  select v.id, v.id as visit_id, v.patient_id, t.total_amount,
         case o.o_orderstatus when 'F' then 'paid' when 'O' then 'pending' else 'partially_paid' end as status,
         case when o.o_orderstatus = 'F' then case v.id % 4 when 0 then 'cash' when 1 then 'card' when 2 then 'upi'
              else 'insurance' end end as payment_method,
         case when o.o_orderstatus = 'F' then cast(o.o_orderdate as date) end as payment_date,
         cast(o.o_orderdate as date) as created_date
  from visits v join orders o on o.o_orderkey = v.id
  join (select billing_record_id, cast(sum(amount) as decimal(10,2)) as total_amount
        from billing_items group by billing_record_id) t on t.billing_record_id = v.id)
"""

# The document catalogue of sources.files.documents_catalogue.
DOCUMENTS_CATALOGUE = """
      SELECT *, file_type IN ('pdf', 'jpg', 'jpeg', 'png') AS accepted FROM (
        SELECT doc_id AS document_id, doc_id AS patient_id, 'document ' || doc_id || '.' || file_type AS file_name, file_type,
          CAST(n_chars AS BIGINT) AS file_size_bytes, source AS document_category,
          DATE '2000-01-01' + CAST(doc_id % 577 AS INTEGER) AS uploaded_at
        FROM (SELECT *, CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'jpg' WHEN 'fr' THEN 'png' ELSE 'txt' END AS file_type
              FROM documents))"""


def with_clinic(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    """Prefix ``body`` (a SELECT) with the clinic mapping CTEs.

    ``extra_ctes`` is a comma-separated list of further ``name AS (...)``
    definitions that may read the clinic tables.
    """
    ctes = MAPPING_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"
