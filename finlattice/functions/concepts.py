"""Concept lists of the identity checks and metrics. Results depend on their members and order."""

SUBTOTAL_CONCEPTS = (
    "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "CostsAndExpenses", "OperatingExpenses", "GrossProfit", "OperatingIncomeLoss", "NonoperatingIncomeExpense",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments",
    "IncomeLossFromContinuingOperations", "ProfitLoss", "NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "ComprehensiveIncomeNetOfTax",
    "ComprehensiveIncomeNetOfTaxIncludingPortionAttributableToNoncontrollingInterest", "OtherComprehensiveIncomeLossNetOfTax", "OtherComprehensiveIncomeLossNetOfTaxPortionAttributableToParent",
    "AssetsCurrent", "AssetsNoncurrent", "Assets", "LiabilitiesCurrent", "LiabilitiesNoncurrent", "Liabilities", "StockholdersEquity",
    "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "LiabilitiesAndStockholdersEquity",
    "NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInFinancingActivities",
    "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations",
    "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations", "CashAndCashEquivalentsPeriodIncreaseDecrease",
    "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect",
    "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect",
    "CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "InterestAndDividendIncomeOperating", "InterestExpense",
    "InterestIncomeExpenseNet", "InterestIncomeExpenseAfterProvisionForLoanLoss", "NoninterestIncome", "NoninterestExpense",
)
SUBTOTAL_LABEL = r"(?i)^\s*(total|net (income|loss|earnings|cash)|gross (profit|margin)|operating (income|loss|profit))\b"
REVENUE = (
    "Revenues", "Revenue", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet", "SalesRevenueGoodsNet", "RevenuesNetOfInterestExpense",
)
COST_OF_REVENUE = (
    "CostOfRevenue", "CostOfSales", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices", "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization",
)
PRETAX = (
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "ProfitLossBeforeTax",
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesDomestic",
)
FOREIGN_PRETAX = ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesForeign",)
TAX = ("IncomeTaxExpenseBenefit", "IncomeTaxExpenseContinuingOperations")
CONTINUING_ONLY = (
    "IncomeLossFromContinuingOperationsIncludingPortionAttributableToNoncontrollingInterest", "ProfitLossFromContinuingOperations", "IncomeLossFromContinuingOperations",
)
TOTAL_INCOME = ("ProfitLoss", "NetIncomeLoss")
EPS_FALLBACK_NUMERATOR = ("NetIncomeLoss", "ProfitLossAttributableToOwnersOfParent", "ProfitLoss")
NONCONTROLLING_INCOME = ("NetIncomeLossAttributableToNoncontrollingInterest", "ProfitLossAttributableToNoncontrollingInterests")
DISCONTINUED = (
    "IncomeLossFromDiscontinuedOperationsNetOfTax", "IncomeLossFromDiscontinuedOperationsNetOfTaxAttributableToReportingEntity",
    "IncomeLossFromDiscontinuedOperationsNetOfTaxIncludingPortionAttributableToNoncontrollingInterest", "ProfitLossFromDiscontinuedOperations",
)
EQUITY_METHOD = ("IncomeLossFromEquityMethodInvestments", "ShareOfProfitLossOfAssociatesAndJointVenturesAccountedForUsingEquityMethod")
PREFERRED_DIVIDENDS = ("PreferredStockDividendsAndOtherAdjustments", "PreferredStockDividendsIncomeStatementImpact", "DividendsPreferred", "PreferredStockDividendsShares")
EPS_NUMERATOR = ("NetIncomeLossAvailableToCommonStockholdersBasic", "NetIncomeLossAvailableToCommonStockholdersDiluted")
EPS = {"basic": ("EarningsPerShareBasic", "WeightedAverageNumberOfSharesOutstandingBasic"), "diluted": ("EarningsPerShareDiluted", "WeightedAverageNumberOfDilutedSharesOutstanding")}
CROSS_CASH = ("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "CashAndCashEquivalentsAtCarryingValue")
EQUITY_TOTAL = ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity", "Equity")
LIABILITIES_AND_EQUITY = ("LiabilitiesAndStockholdersEquity", "EquityAndLiabilities")
TEMPORARY_EQUITY = ("TemporaryEquityCarryingAmountIncludingPortionAttributableToNoncontrollingInterest", "TemporaryEquityCarryingAmountAttributableToParent")
OPERATING_CF = ("NetCashProvidedByUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivities")
INVESTING_CF = ("NetCashProvidedByUsedInInvestingActivities", "CashFlowsFromUsedInInvestingActivities")
FINANCING_CF = ("NetCashProvidedByUsedInFinancingActivities", "CashFlowsFromUsedInFinancingActivities")
NET_CHANGE_WITH_FX = (
    "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseIncludingExchangeRateEffect", "CashAndCashEquivalentsPeriodIncreaseDecrease", "IncreaseDecreaseInCashAndCashEquivalents",
)
NET_CHANGE_WITHOUT_FX = (
    "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect",
    "CashAndCashEquivalentsPeriodIncreaseDecreaseExcludingExchangeRateEffect", "IncreaseDecreaseInCashAndCashEquivalentsBeforeEffectOfExchangeRateChanges",
)
FX_EFFECT = (
    "EffectOfExchangeRateOnCashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "EffectOfExchangeRateOnCashAndCashEquivalents",
    "EffectOfExchangeRateOnCashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsIncludingDisposalGroupAndDiscontinuedOperations", "EffectOfExchangeRateChangesOnCashAndCashEquivalents",
)
#: Metric: its statement, and the concepts that give it, the first that a filing has.
METRICS = {
    "revenue": ("IS", (*REVENUE, "InterestAndDividendIncomeOperating", "TotalRevenuesAndOtherIncome")),
    "net_income": ("IS", ("NetIncomeLoss", "ProfitLoss", "ProfitLossAttributableToOwnersOfParent", "NetIncomeLossAvailableToCommonStockholdersBasic", "IncomeLossFromContinuingOperations")),
    "eps_diluted": ("IS", ("EarningsPerShareDiluted", "DilutedEarningsLossPerShare", "EarningsPerShareBasicAndDiluted")),
    "total_assets": ("BS", ("Assets",)),
    "operating_cash_flow": ("CF", OPERATING_CF),
    "gross_profit": ("IS", ("GrossProfit",)),
    "operating_income": ("IS", ("OperatingIncomeLoss",)),
    "pretax_income": ("IS", (PRETAX[0], PRETAX[2])),
    "income_tax": ("IS", ("IncomeTaxExpenseBenefit",)),
    "eps_basic": ("IS", ("EarningsPerShareBasic", "EarningsPerShareBasicAndDiluted")),
    "shares_diluted": ("IS", ("WeightedAverageNumberOfDilutedSharesOutstanding",)),
    "net_interest_income": ("IS", ("InterestIncomeExpenseNet", "InterestIncomeExpenseAfterProvisionForLoanLoss")),
    "provision_for_credit_losses": ("IS", ("ProvisionForLoanLeaseAndOtherLosses", "ProvisionForLoanLossesExpensed", "ProvisionForCreditLosses")),
    "noninterest_income": ("IS", ("NoninterestIncome",)),
    "cash": ("BS", ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents")),
    "total_liabilities": ("BS", ("Liabilities",)),
    "total_equity": ("BS", ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")),
    "long_term_debt": ("BS", ("LongTermDebtNoncurrent", "LongTermDebt")),
    "deposits": ("BS", ("Deposits",)),
    "loans": ("BS", ("LoansAndLeasesReceivableNetReportedAmount", "NotesReceivableNet")),
    "capex": ("CF", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets")),
    "investing_cash_flow": ("CF", ("NetCashProvidedByUsedInInvestingActivities",)),
    "financing_cash_flow": ("CF", ("NetCashProvidedByUsedInFinancingActivities",)),
    "dividends_paid": ("CF", ("PaymentsOfDividends", "PaymentsOfDividendsCommonStock")),
    "buybacks": ("CF", ("PaymentsForRepurchaseOfCommonStock",)),
    "depreciation": ("CF", ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "Depreciation")),
}
