SELECT s.quarter, COUNT(*) AS orders, SUM(o.amount) AS revenue, AVG(o.units) AS mean_units
FROM orders AS o
INNER JOIN shops AS s ON o.shop_id = s.shop_id
WHERE o.amount >= 4.0
GROUP BY s.quarter
ORDER BY revenue DESC, quarter NULLS FIRST
LIMIT 10;
