"""Column roles and fixed names shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Source column name -> engine column name.
SOURCE_NAMES = {
    "transaction_date": "date",
    "internal_store_id": "store",
    "internal_product_id": "product",
    "quantidade": "quantity",
    "data": "date",
    "pdv": "store",
    "produto": "product",
    "data_semana": "week_date",
    "ano": "year",
    "semana": "week",
    "semana_ano": "week_label",
    "categoria": "category",
    "subcategoria": "subcategory",
    "marca": "brand",
    "preco_unitario": "unit_price",
    "categoria_pdv": "store_category",
}

# Names under which a dimension may carry its key.
STORE_KEY_NAMES = ("store", "internal_store_id", "store_id", "pdv_id", "pdv")
PRODUCT_KEY_NAMES = ("product", "internal_product_id", "product_id", "produto_id", "produto")

STORE_ATTRIBUTES = ("premise", "store_category", "zipcode")
PRODUCT_ATTRIBUTES = ("category", "subcategory", "brand", "unit_price")
MONEY = ("gross_value", "net_value", "gross_profit", "discount", "taxes")


@dataclass(frozen=True)
class SeriesSpec:
    """Names of the columns that identify, order and measure a series."""

    store: str = "store"
    product: str = "product"
    date: str = "date"
    target: str = "quantity"
    week_date: str = "week_date"
    year: str = "year"
    week: str = "week"
    money: tuple[str, ...] = MONEY

    @property
    def series(self) -> list[str]:
        return [self.store, self.product]

    @property
    def panel_key(self) -> list[str]:
        return [self.store, self.product, self.year, self.week]

    @property
    def forecast_key(self) -> list[str]:
        return [self.week, self.store, self.product]

    @property
    def order(self) -> list[str]:
        return [self.week_date, self.year, self.week]


DEFAULT = SeriesSpec()
