-- The customer of the highest balance in each market segment; of equal balances the one of the lowest key.
SELECT segment, customer, balance FROM (
  SELECT c_mktsegment AS segment, c_custkey AS customer, c_acctbal AS balance,
    ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place
  FROM resource_customer WHERE c_acctbal >= ${least_balance}
) WHERE place = 1;
