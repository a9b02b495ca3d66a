-- Daily revenue per (payment date, department), as Spark SQL over the
-- clinic tables registered as temporary views. :since is a named parameter
-- (the oldest payment date to refresh).
WITH per_invoice AS (
  SELECT billing_record_id,
         SUM(amount) FILTER (WHERE category = 'consultation') AS consultation,
         SUM(amount) FILTER (WHERE category = 'test') AS test,
         SUM(amount) FILTER (WHERE category = 'procedure') AS procedure,
         SUM(amount) FILTER (WHERE category = 'other') AS other,
         SUM(amount) AS total
  FROM billing_items GROUP BY billing_record_id)
SELECT br.payment_date AS date, d.id AS department_id, d.name AS department_name,
       CAST(COALESCE(SUM(i.consultation), 0) AS DECIMAL(12,2)) AS consultation_revenue,
       CAST(COALESCE(SUM(i.test), 0) AS DECIMAL(12,2)) AS test_revenue,
       CAST(COALESCE(SUM(i.procedure), 0) AS DECIMAL(12,2)) AS procedure_revenue,
       CAST(COALESCE(SUM(i.other), 0) AS DECIMAL(12,2)) AS other_revenue,
       CAST(COALESCE(SUM(i.total), 0) AS DECIMAL(12,2)) AS total_revenue,
       COUNT_IF(br.status = 'paid') AS paid_count,
       COUNT_IF(br.status = 'pending') AS pending_count
FROM billing_records br
JOIN per_invoice i ON i.billing_record_id = br.id
JOIN visits v ON v.id = br.visit_id
JOIN appointments a ON a.id = v.appointment_id
JOIN departments d ON d.id = a.department_id
WHERE br.payment_date IS NOT NULL AND br.payment_date >= :since
GROUP BY br.payment_date, d.id, d.name
